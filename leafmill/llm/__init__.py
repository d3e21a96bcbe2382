"""Corpus operators for training-data pipelines.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it; ``registry`` lists its queries.
"""
