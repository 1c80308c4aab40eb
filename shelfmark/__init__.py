"""Document ingestion, retrieval and corpus analytics on Spark DataFrames."""
