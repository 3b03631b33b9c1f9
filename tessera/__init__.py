"""tessera: retrieval, code-memory and text-corpus analytics on Spark DataFrames."""
