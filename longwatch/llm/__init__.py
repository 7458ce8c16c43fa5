"""Training-data operators: formatting, mixing, filters, near-dedup, tokenizing.

Nothing outside this subpackage imports it.
"""
