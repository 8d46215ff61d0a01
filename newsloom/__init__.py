"""News and event analytics as Spark DataFrame jobs."""
