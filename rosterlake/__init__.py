"""Player ratings and tournament analytics as Spark jobs."""
