"""Inputs: rule catalogues and corpora."""
