"""Operators for preparing language-model training data.

Nothing outside this package (and the pipeline file beside it) imports it.
"""
