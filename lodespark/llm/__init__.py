"""Operators for text and vector collections; nothing outside this folder imports it."""
