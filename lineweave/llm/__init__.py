"""Operators that prepare large text collections for language models.

Nothing outside this folder imports it; the library works without it.
"""
