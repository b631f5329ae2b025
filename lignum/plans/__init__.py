"""The three analyses, composed of operators."""
