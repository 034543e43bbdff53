"""Per-key results where a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize


def heavy_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The keys holding more than ``share`` of all rows (null keys included).

    At most ``1 / share`` keys can do so, whatever the data's size: that bound is
    what makes the result safe to broadcast. Counting combines map-side.
    """
    if not 0 < share <= 1:
        raise ValueError("share lies in (0, 1]")
    counts = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") > F.lit(share * total)).select(key)


def salted(rows: DataFrame, key: str, spread_by: list[str], share: float, salts: int) -> DataFrame:
    """``rows`` with a column ``_salt``: 0 for light keys, 0..salts-1 for heavy ones.

    The salt is a hash of ``spread_by``, so that it is random against the key yet
    the same when a lost task is run again, and so that all rows agreeing in
    ``spread_by`` share a salt (distinct counts over it then add up across salts).
    """
    heavy = heavy_keys(rows, key, share).select(F.col(key).alias("_heavy_key"), F.lit(True).alias("_is_heavy"))
    joined = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy_key")), "left")
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    return joined.withColumn("_salt", F.when(F.col("_is_heavy"), spread).otherwise(F.lit(0))).drop("_heavy_key", "_is_heavy")


def salted_aggregate(
    rows: DataFrame,
    key: str,
    spread_by: list[str],
    partials: dict[str, Column],
    merges: dict[str, Column],
    share: float = 0.001,
    salts: int = 64,
) -> DataFrame:
    """One row per key. ``partials`` are computed per key and salt, ``merges`` per
    key over the partials' columns; both stages also combine map-side. A null key
    is a key like any other; no rows give no keys."""
    first = salted(rows, key, spread_by, share, salts).groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partials.items()])
    return first.groupBy(key).agg(*[c.alias(n) for n, c in merges.items()])


def posting_groups(postings: DataFrame, files: DataFrame) -> DataFrame:
    """The rows that count, per (trigram, file_id): ``n_rows`` and ``sum_cnt``.

    A row counts if its trigram is not null and its file is known; exact duplicates (in the
    table's five columns; others are not read) count once; a null cnt adds nothing. Rows are
    moved once, by (trigram, file), which spreads a heavy trigram over its files and a heavy
    file over its trigrams: repeats meet there, and so do the rows of a group. The check of
    the file is a semi join: ``files`` is broadcast only below the engine's size threshold,
    and a skewed side is split.
    """
    cols = ["trigram", "file_id", "block", "cnt", "build_id"]
    known = files.select("file_id").filter(F.col("file_id").isNotNull()).distinct()
    rows = postings.select(*cols).filter(F.col("trigram").isNotNull() & F.col("file_id").isNotNull())
    groups = (
        rows.repartition("trigram", "file_id")
        .distinct()
        .groupBy("trigram", "file_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.col("cnt").cast("long"), F.lit(0).cast("long"))).alias("sum_cnt"))
    )
    return groups.join(known, "file_id", "left_semi")


def trigram_stats(postings: DataFrame, files: DataFrame, share: float = 0.001, salts: int = 64) -> DataFrame:
    """Per trigram over the valid rows: n_rows, n_files, sum_cnt (all bigint).

    Rows are first grouped per (trigram, file), a key that no trigram dominates; then
    per (trigram, salt of the file) for heavy trigrams; then per trigram.
    """
    groups = materialize(posting_groups(postings, files), "posting-groups")
    return salted_aggregate(
        groups,
        "trigram",
        ["file_id"],
        {"r": F.sum("n_rows"), "f": F.count(F.lit(1)), "c": F.sum("sum_cnt")},
        {"n_rows": F.sum("r"), "n_files": F.sum("f"), "sum_cnt": F.sum("c")},
        share,
        salts,
    )


def dominant_trigrams(postings: DataFrame, files: DataFrame, percent: int = 2) -> DataFrame:
    """Trigrams with more than ``percent`` of the valid rows, judged in whole numbers."""
    stats = materialize(trigram_stats(postings, files), "trigram-stats")
    total = stats.agg(F.sum("n_rows")).first()[0] or 0
    return stats.filter(F.col("n_rows") * 100 > F.lit(total * percent)).select("trigram")
