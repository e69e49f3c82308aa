"""Corpus operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers the thin ``opN_*`` queries.
Nothing else in the library imports this subpackage.
"""
