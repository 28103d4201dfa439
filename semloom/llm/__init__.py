"""Operators for preparing language-model training data.

Nothing else in ``semloom`` imports this subpackage; it may be deleted together with ``tests/llm`` and
``corpus_pipeline.py``.
"""
