"""Operators for preparing large language-model training data; nothing else in the library imports them."""
