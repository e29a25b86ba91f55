"""Document retrieval and corpus processing as Spark DataFrame programs."""
