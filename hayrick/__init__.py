"""Hayrick: hybrid retrieval and corpus analytics as plain PySpark DataFrame code."""
