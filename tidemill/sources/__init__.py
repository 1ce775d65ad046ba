"""Readers for landing files and the tables they end up in."""
