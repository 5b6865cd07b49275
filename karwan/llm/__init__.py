"""Operators for large text and vector collections; nothing outside this folder imports them."""
