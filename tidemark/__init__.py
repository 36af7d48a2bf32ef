"""Tidemark: document and log analytics as Spark plans."""
