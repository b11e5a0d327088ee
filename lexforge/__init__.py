"""lexforge: a document-knowledge engine written on PySpark DataFrames."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
