"""Operators for training-data pipelines.

Thirteen operators over the tables ``documents``, ``embeddings``, ``pages``,
``labels`` and ``conversations``. Nothing outside this subpackage (and ``corpus_pipeline.py``)
imports it; ``queries.py`` registers one query per operator.
"""
