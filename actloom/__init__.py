"""Retrieval and corpus analytics as plain PySpark DataFrame programs."""
