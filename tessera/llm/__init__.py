"""Operators for preparing text and chunk collections; nothing outside this package imports it."""
