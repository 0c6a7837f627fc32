"""Document, code and conversation analytics on PySpark."""
