"""lectern: document ingestion, full-text search and retrieval on PySpark DataFrames."""
