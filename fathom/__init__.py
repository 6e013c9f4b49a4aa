"""Document retrieval and ranking analytics on Spark."""
