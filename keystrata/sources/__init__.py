"""Fixed-length record files as a Spark data source and sink."""
