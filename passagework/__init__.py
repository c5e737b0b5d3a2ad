"""Document chunking, indexing and search expressed as Spark DataFrame jobs."""
