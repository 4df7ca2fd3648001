"""Security-log analytics on Spark."""
