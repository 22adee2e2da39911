"""factweave: document-knowledge analytics as Spark DataFrame, SQL and streaming plans."""
