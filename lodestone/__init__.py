"""Lodestone: set-based catalog lookup, enrichment and corpus preparation on PySpark."""
