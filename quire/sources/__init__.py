"""Library analytics on Spark: sources."""
