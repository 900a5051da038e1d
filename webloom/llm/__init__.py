"""Operators for preparing training corpora.

The subpackage stands alone: it uses nothing else of the library, and nothing
else of the library uses it.
"""
