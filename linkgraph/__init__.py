"""Traceability analytics on Spark: documents as a typed link graph, queried as DataFrames."""
