"""waymark: trip and destination analytics as plain Spark DataFrame operators."""
