"""Parquet tables as sources: the scratch folder, and rows of `documents` and `pages` as files."""

from __future__ import annotations

import functools
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "json", "sh", "tex")


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="lignum-")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a temporary folder on a local master and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
    return "file://" + _local_scratch()


def checkouts(spark: SparkSession) -> Path:
    """A folder for clones that executors reach by the same path; on a cluster it must be mounted."""
    scheme, colon, path = shared_folder(spark).partition(":")
    if colon and scheme != "file":
        raise RuntimeError("to clone, spark.checkpoint.dir must be a mounted folder")
    folder = Path("/" + (path if colon else scheme).lstrip("/")) / "checkouts"
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rewritten(text: Column) -> Column:
    """Prose with blank, comment and indented lines and mixed line ends, to be counted as code."""
    return F.replace(F.replace(text, F.lit(". "), F.lit("\n\n# ")), F.lit(", "), F.lit("\r\n  "))


def files_of(path: Column, content: Column, *more: Column) -> list[Column]:
    return [path.alias("path"), F.octet_length(content).cast("bigint").alias("size_bytes"), F.encode(content, "UTF-8").alias("content"), *more]


def document_files(documents: DataFrame) -> DataFrame:
    """documents as files source/lang/doc_id.ext of four languages without block comments."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext))
    return documents.select(*files_of(path, rewritten(F.coalesce("text", F.lit("")))))


def page_files(pages: DataFrame) -> DataFrame:
    """pages as HTML files."""
    return pages.select(*files_of(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.coalesce("html", F.lit(""))))
