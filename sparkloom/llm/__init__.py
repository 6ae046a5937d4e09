"""Training-data operators: de-duplication, tokenizing, mixing, scoring and exact search.

Nothing outside this package imports it.
"""
