"""Operators for preparing training data from a text corpus; nothing else in the library imports this."""
