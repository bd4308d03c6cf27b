"""Corpus operators for training data; each module is one operator, ``queries`` registers them.

Nothing outside this subpackage imports it.
"""
