def files(spark, tree):
    """A table of files from {path: text}."""
    return spark.createDataFrame([(p, len(t.encode()), bytearray(t.encode())) for p, t in tree.items()], "path string, size_bytes long, content binary")
