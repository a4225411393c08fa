"""Tomewright: a Spark-first engine for document knowledge bases and training corpora."""
