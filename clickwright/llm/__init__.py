"""Operators of a training-data pipeline (one module each) and their registered queries.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
