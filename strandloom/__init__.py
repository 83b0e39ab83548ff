"""Strandloom: document-retrieval analytics as Spark DataFrame plans."""
