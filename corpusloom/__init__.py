"""Document-corpus and retrieval analytics as Spark DataFrame jobs."""
