"""Operators for large text corpora: quality, repair, canonical form, segmentation, encoding, mixing, language.

Nothing outside this subpackage imports it.
"""
