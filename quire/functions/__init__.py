"""Library analytics on Spark: functions."""
