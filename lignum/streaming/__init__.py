"""The operators over arriving files."""
