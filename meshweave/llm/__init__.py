"""Operators for preparing training data, on DataFrames of documents and conversations."""
