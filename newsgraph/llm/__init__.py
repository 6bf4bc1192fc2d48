"""Operators for building language-model training data; nothing else in the package depends on this folder."""
