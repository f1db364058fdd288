"""siltstone: document retrieval and evidence analytics on Spark DataFrames."""
