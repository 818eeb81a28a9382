"""Operators for training data of language models. Nothing outside this package imports it."""

QUERY_MODULES = ["sparvex.llm.queries"]
