"""Operators for large training corpora. Nothing else of the library imports this subpackage."""
