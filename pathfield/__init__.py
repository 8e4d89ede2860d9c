"""pathfield: trajectory and point-pattern analytics as Spark DataFrame operators."""
