"""Operators of a training-data pipeline: quality, toxicity, deduplication, mixing, tokens, archives.

Nothing outside this subpackage imports it; queries live in ``tidemark.llm.queries``.
"""
