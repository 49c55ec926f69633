"""Operators for building language-model training data out of document tables."""
