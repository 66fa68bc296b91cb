"""Analytics on entity x date panels, as Spark DataFrame operations."""
