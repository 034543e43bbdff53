"""The queries of this subpackage: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, kinds, packing, spans
from tessera.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return kinds.not_hand_written(table(spark, d, "documents"), table(spark, d, "vendor_items"))


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return kinds.source_kinds(table(spark, d, "documents"), table(spark, d, "vendor_items"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_corpus(table(spark, d, "documents"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens held, the fewest containers thinkable, and the space left over."""
    rows = p7_containers(spark, d).filter("container IS NOT NULL")
    n, t = F.countDistinct("container"), F.sum("n_tokens")
    cap = F.lit(packing.CAPACITY)
    return rows.agg(n.alias("containers"), t.alias("tokens")).select("containers", "tokens", F.ceil(F.col("tokens") / cap).alias("least"), (F.col("containers") * cap - F.col("tokens")).alias("left_over"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def catalogue() -> dict:
    return {
        "p4_found": (p4_found, None),
        "p4_kinds": (p4_kinds, None),
        "p6_ids": (p6_ids, None),
        "p7_containers": (p7_containers, None),
        "p7_summary": (p7_summary, None),
        "p8_found": (p8_found, None),
        "p8_share": (p8_share, None),
    }
