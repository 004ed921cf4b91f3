"""Operators for training-data pipelines over a corpus of documents.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
