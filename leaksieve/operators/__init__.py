"""Relational operators of a scan."""
