"""Operators for large training corpora.

Nothing outside this package imports it; ``pursuit.llm.queries`` registers its queries.
"""
