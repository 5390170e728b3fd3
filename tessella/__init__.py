"""A Spark-first engine for registering multi-sensor planetary imagery."""
