"""Tessera: retrieval, document structuring and evaluation as Spark plans."""
