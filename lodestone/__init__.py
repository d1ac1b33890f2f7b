"""Retrieval and activity analytics over a document corpus, as PySpark DataFrame operators."""
