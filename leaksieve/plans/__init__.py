"""Whole scans and reports, composed from the operators."""
