"""Operators for building training data for language models.

Nothing outside this subpackage imports it; of the rest it uses the written tables alone.
"""
