"""Failure-risk analytics on production-line data, as PySpark DataFrame operators."""
