"""Session, scratch-table and hashing helpers shared by the operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="lignum-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`.

    Unset, a local master (tests) gets a temporary folder; a cluster is
    refused, as a machine-local folder would not outlive its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _local_scratch()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage durably (a lost executor never forces the work again) and
    gives Catalyst true sizes, so joins against small tables broadcast only
    when they really are small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lignum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order_hash(col: Column, salt: str = "") -> Column:
    """60-bit pseudo-random key of an id: the first 15 hex digits of md5.

    Null ids hash as the text 'null'. The SQL twin is `order_hash_sql`.
    """
    text = F.concat(F.lit(salt), F.coalesce(col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def order_hash_sql(expr: str, salt: str = "") -> str:
    return f"CAST('0x' || substr(md5('{salt}' || coalesce(CAST({expr} AS VARCHAR), 'null')), 1, 15) AS BIGINT)"


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens (space, tab, line feed, carriage return); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def token_count_sql(expr: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({expr}, ''), '[^ \\t\\r\\n]+')) AS BIGINT)"


def subset(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with working ones."""
    return docs.select(*names)
