"""DataFrame -> DataFrame steps; none of them touches files."""
