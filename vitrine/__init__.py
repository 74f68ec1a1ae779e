"""Catalogue search, facets, indexing and index analytics as Spark DataFrame plans."""
