"""Frequency of every term by recursive radix partitioning, aggregated by DuckDB.

The rows are written once. Level by level their buckets by hash bits are counted, and those
with more rows than a leaf may have are split by the next bits. Then each row moves once, to
its leaf: the engine's shuffle files are the partitions on disk, sorted by leaf, and a task
hands DuckDB as many whole leaves at a time as together are no larger than one may be.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import discard, materialize, shared_dir

#: Hash bits looked at per level, and levels at most (together all 64 bits of the hash).
RADIX_BITS = 8
MAX_LEVELS = 8
#: Rows of a leaf: what DuckDB holds at a time, about 40 bytes each.
LEAF_ROWS = 250_000
ROW = ["term", "file_id", "block", "cnt", "build_id"]


def _prefix(level: int) -> Column:
    """The first ``level + 1`` digits of the term's hash."""
    return F.shiftrightunsigned(F.col("_h"), 64 - RADIX_BITS * (level + 1))


def radix_leaves(groups: DataFrame, term: str, record: str, leaf_rows: int) -> DataFrame:
    """``groups`` with a column ``_leaf``. Rows with equal term and record share a leaf.

    Level by level, the buckets with more than ``leaf_rows`` rows are split by the next
    hash bits. A bucket that is one term cannot be split so; its rows are spread by their
    record instead, and the term's partial sums are merged at the end. What is too large
    stays a table: no list of buckets reaches the driver.
    """
    rows = groups.withColumn("_h", F.xxhash64(term)).withColumn("_leaf", _prefix(0)).withColumn("_pieces", F.lit(1)).withColumn("_open", F.lit(True))
    for level in range(MAX_LEVELS):
        sizes = rows.filter("_open").groupBy(F.col("_leaf").alias("_l")).agg(F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        large = materialize(sizes.filter(F.col("n") > leaf_rows), "radix-level")
        if large.isEmpty():
            break
        rows = rows.join(large, F.col("_leaf") == F.col("_l"), "left")
        split = F.col("n").isNotNull() & F.col("_open")
        one = F.col("lo") == F.col("hi")
        last = level + 1 == MAX_LEVELS
        rows = (
            rows.withColumn("_pieces", F.when(split & (one | F.lit(last)), F.ceil(F.col("n") / leaf_rows).cast("int")).otherwise(F.col("_pieces")))
            .withColumn("_leaf", F.when(split & ~one & F.lit(not last), F.xxhash64(F.lit(level + 1), _prefix(min(level + 1, MAX_LEVELS - 1)))).otherwise(F.col("_leaf")))
            .withColumn("_open", split & ~one)
            .drop("_l", "n", "lo", "hi")
        )
    piece = F.when(F.col("_pieces") > 1, F.pmod(F.xxhash64(record), F.col("_pieces"))).otherwise(F.lit(0))
    return rows.withColumn("_leaf", F.xxhash64("_leaf", piece)).drop("_h", "_pieces", "_open")


_SUMS = """SELECT term, sum(n)::BIGINT AS n_rows, count(*) AS n_files, sum(c)::BIGINT AS sum_cnt FROM (
  SELECT term, file_id, count(*) AS n, sum(coalesce(cnt, 0)) AS c FROM (SELECT DISTINCT term, file_id, block, cnt, build_id FROM leaves) GROUP BY term, file_id)
GROUP BY term"""


def _leaf_sums(spill: str, memory_mb: int, leaf_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Aggregates a task's rows, which come sorted by leaf, some whole leaves at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill and f"{spill}/{uuid.uuid4().hex}"})
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con.register("leaves", pa.Table.from_batches(parts))
            yield from con.sql(_SUMS).to_arrow_table().to_batches()
            con.unregister("leaves")

        try:
            for batch in batches:
                leaf = batch.column(0).to_numpy()
                at = 0
                for end in [*(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]:
                    new = at > 0 or not held or held[-1].column(0)[-1].as_py() != leaf[0]
                    if new and size and size + end - at > leaf_rows:
                        yield from flush(held)
                        held, size = [], 0
                    if end > at:
                        held.append(batch.slice(at, end - at))
                    size += end - at
                    at = end
            if held:
                yield from flush(held)
        finally:
            con.close()

    return run


def valid_rows(postings: DataFrame, files: DataFrame) -> DataFrame:
    """(term, file_id, block, cnt, build_id): rows with a trigram, of known files."""
    known = files.select("file_id").filter(F.col("file_id").isNotNull()).distinct()
    rows = postings.filter(F.col("trigram").isNotNull() & F.col("file_id").isNotNull())
    return rows.select(F.col("trigram").cast("long").alias("term"), *ROW[1:]).join(known, "file_id", "left_semi").select(*ROW)


def term_frequencies(postings: DataFrame, files: DataFrame, leaf_rows: int = LEAF_ROWS, memory_mb: int = 256) -> DataFrame:
    """Per trigram over the valid rows: n_rows, n_files, sum_cnt. Exact duplicates (in the
    table's five columns) count once; a null cnt adds nothing; no rows give none.

    Leaves go to tasks by hash. DuckDB holds ``leaf_rows`` rows or one leaf at a time, within
    ``memory_mb``. Should a leaf need more (one term, one record, very many repeats), it
    spills to the shared folder where that is a mounted path, and nowhere else.
    """
    rows = materialize(valid_rows(postings, files), "radix-rows")
    sums = _row_sums(rows, leaf_rows, memory_mb)
    discard(rows)
    return sums


def _row_sums(rows: DataFrame, leaf_rows: int, memory_mb: int) -> DataFrame:
    shared = shared_dir(rows.sparkSession)
    mounted = shared.removeprefix("file://") if shared.startswith(("file:", "/")) else ""
    spill = os.path.join(mounted.removeprefix("file:"), "duckdb") if mounted else ""
    leaves = radix_leaves(rows, "term", "file_id", leaf_rows).repartition("_leaf").sortWithinPartitions("_leaf")
    partial = leaves.select("_leaf", *ROW).mapInArrow(_leaf_sums(spill, memory_mb, leaf_rows), "term long, n_rows long, n_files long, sum_cnt long")
    sums = partial.groupBy(F.col("term").cast("int").alias("trigram")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_files").alias("n_files"), F.sum("sum_cnt").alias("sum_cnt"))
    return materialize(sums, "radix-sums")


def marked_frequencies(postings: DataFrame, files: DataFrame, rare_files: int = 2, common_share: tuple[int, int] = (1, 5), leaf_rows: int = LEAF_ROWS, memory_mb: int = 256) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` for at most ``rare_files`` files, else
    ``common`` for more than ``common_share`` of the files that have a valid row, else null."""
    rows = materialize(valid_rows(postings, files), "radix-rows")
    held = rows.select("file_id").distinct().count()
    sums = _row_sums(rows, leaf_rows, memory_mb)
    discard(rows)
    num, den = common_share
    mark = F.when(F.col("n_files") <= rare_files, F.lit("rare")).when(F.col("n_files") * den > F.lit(held * num), F.lit("common"))
    return sums.withColumn("mark", mark)


def build_claims(postings: DataFrame, files: DataFrame, build_stats: DataFrame) -> DataFrame:
    """Per build: what it claims (distinct_trigrams, posting_entries) beside what its own
    valid rows hold. A null claim stays null; a build without rows holds 0."""
    cols = ["trigram", "file_id", "block", "cnt", "build_id"]
    known = files.select("file_id").filter(F.col("file_id").isNotNull()).distinct()
    rows = postings.select(*cols).filter(F.col("trigram").isNotNull() & F.col("build_id").isNotNull()).distinct().join(known, "file_id", "left_semi")
    per = rows.groupBy("build_id", "trigram").agg(F.count(F.lit(1)).alias("n")).groupBy("build_id").agg(F.count(F.lit(1)).alias("held_trigrams"), F.sum("n").alias("held_entries"))
    return build_stats.select("build_id", F.col("distinct_trigrams").alias("claimed_trigrams"), F.col("posting_entries").alias("claimed_entries")).join(per, "build_id", "left").na.fill(0, ["held_trigrams", "held_entries"])
