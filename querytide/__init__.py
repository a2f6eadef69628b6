"""Query-workload trace analytics as plain Spark DataFrame jobs."""
