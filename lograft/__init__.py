"""Device-log analytics as Spark DataFrame and Structured Streaming operators."""
