"""loomfield: corpus preparation and evaluation analytics as Spark DataFrame operators."""
