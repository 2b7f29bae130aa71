"""larkspur: document ingestion, indexing and ranked retrieval on PySpark."""
