"""Document-request analytics as Spark DataFrame and Structured Streaming jobs."""
