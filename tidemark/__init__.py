"""Calendar-bucket analytics as plain Spark DataFrame jobs."""
