"""tidemark: ordered-event and interval analytics as plain PySpark DataFrame code."""
