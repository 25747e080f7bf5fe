"""How checks are put together into few Spark jobs."""
