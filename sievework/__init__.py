"""Sievework: integrate what many independent sources report, and prepare corpora, on PySpark."""
