"""Operators for text and linkage work on training data; nothing outside this folder imports them."""
