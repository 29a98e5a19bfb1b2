"""Search and brand content analytics as Spark DataFrame jobs."""
