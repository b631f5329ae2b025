"""The driver's queries of these operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, htmltext, langid, mixing, mpegts, outliers, packing, sharding, simhash, warc
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_quality_outliers": _on("documents", outliers.score),
    "op2_chat_transcripts": _on("conversations", chat.format_chats),
    "op3_mixture_packing": _on("documents", packing.pack),
    "op4_html_layout": _on("pages", htmltext.extract),
    "op5_mpeg_ts": _on("pages", lambda pages: mpegts.flat(mpegts.read_streams(mpegts.streams_of(pages)))),
    "op6_hilbert_shards": _on("documents", sharding.shard),
    "op7_language_id": _on("documents", langid.identify),
    "op8_simhash_near_dedup": _on("documents", simhash.near_duplicates),
    "op9_warc_segments": _on("pages", lambda pages: warc.text_bodies(warc.reassemble(warc.read_records(warc.archives_of(pages))))),
    "op10_source_mixing": _on("documents", mixing.mix),
}

ORACLES: dict[str, str] = {
    "op3_mixture_packing": packing.pack_sql(),
    "op5_mpeg_ts": mpegts.streams_sql(),
    "op6_hilbert_shards": sharding.shard_sql(),
    "op9_warc_segments": warc.reassemble_sql(),
    "op10_source_mixing": mixing.mix_sql(),
}
