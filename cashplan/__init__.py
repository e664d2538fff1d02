"""Cash-flow analytics as Spark DataFrame jobs."""
