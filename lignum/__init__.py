"""Source-tree analytics on Spark: line counts, context packs and dependency graphs."""
