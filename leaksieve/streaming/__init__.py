"""The same scan over arriving files."""
