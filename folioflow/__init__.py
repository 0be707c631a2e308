"""Document processing, retrieval and training-data operations on PySpark."""
