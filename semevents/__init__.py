"""Semantic document streams on Spark: Markdown, HTML and JSON events as DataFrames."""
