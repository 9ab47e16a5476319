"""Operators for training-data pipelines over text, pages and conversations.

Nothing outside this folder imports it; remove it together with ``tests/llm`` and
``corpus_pipeline.py`` and the rest of the library is unaffected.
"""
