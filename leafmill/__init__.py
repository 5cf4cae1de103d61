"""Leafmill: syntax-tree analytics over document corpora, expressed as Spark DataFrame plans."""
