"""Publication-harvest analytics as Spark DataFrame operators."""
