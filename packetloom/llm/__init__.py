"""Operators for preparing training data: a subpackage nothing else in the library imports."""
