"""Incremental streaming-SQL analytics on PySpark."""
