"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
