"""Operators on text and vectors for language-model training data. Nothing outside this subpackage imports it."""
