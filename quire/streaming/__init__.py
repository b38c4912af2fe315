"""Library analytics on Spark: streaming."""
