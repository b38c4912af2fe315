"""Library analytics on Spark: plans."""
