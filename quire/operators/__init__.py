"""Library analytics on Spark: operators."""
