"""wakelane: driver-state analytics as Spark DataFrame operators."""
