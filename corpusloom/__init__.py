"""Corpusloom: document-corpus processing as PySpark DataFrame transformations."""
