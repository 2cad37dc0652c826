"""Operators for building language-model training data out of documents and web pages."""
