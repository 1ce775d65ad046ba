"""tidemill: labelled-text and JSON event files to dated Parquet tables and reports, as Spark plans."""
