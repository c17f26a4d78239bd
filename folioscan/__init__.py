"""A document catalog and hybrid-retrieval engine expressed as Spark DataFrame jobs."""
