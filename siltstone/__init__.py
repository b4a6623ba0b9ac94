"""Siltstone: a document retrieval and data-processing engine on DataFrames."""
