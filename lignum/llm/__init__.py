"""Operators for large-scale training-data pipelines.

Nothing outside this package (and the driver entry point) imports it, so it
can be removed without touching the rest of the library.
"""
