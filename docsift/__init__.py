"""Document relevance classification as PySpark DataFrame operators and jobs."""
