"""Operators for preparing language-model training text.

Self-contained: nothing outside this subpackage imports it, and it imports nothing else of the library.
"""
