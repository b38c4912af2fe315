"""Library analytics on Spark: engine."""
