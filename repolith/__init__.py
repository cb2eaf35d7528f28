"""Repository analytics as Spark DataFrame operators."""
