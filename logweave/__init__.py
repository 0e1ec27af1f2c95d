"""logweave: a Spark-first engine for semi-structured log and event data."""
