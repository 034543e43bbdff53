"""What changed between full listings: a kept store, range-partitioned and sorted by file, and a
merge that streams through each of its ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import resolved
from tessera.operators.intervals import Interval, Ledger, in_sequence, process_new, processed_sequence
from tessera.runtime import fresh_path, materialize, spread, whole_files

KEY = ["root_ord", "path"]
#: Of several readings of one file in one snapshot the last in this order counts.
READING = ["seen_at", "len", "mtime_s", "mtime_ns"]
EVENTS = T.StructType([T.StructField("root_ord", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("change", T.StringType())])


def readings(entries: DataFrame, sequence: DataFrame) -> DataFrame:
    """(root_ord, path, seq, snap_id, seen_at, len, mtime_s, mtime_ns): the readings of the
    snapshots in ``sequence``. Paths are resolved and composed, so that several spellings
    are one file; null paths, unknown snapshots and snapshots without a root are left out."""
    steps = sequence.filter("root_ord IS NOT NULL").select("snap_id", "root_ord", "seq")
    rows = spread(entries.select("snap_id", "path", *READING)).filter(F.col("path").isNotNull()).join(steps, "snap_id")
    kinds = {"root_ord": "int", "seq": "int", "len": "long", "mtime_s": "long", "mtime_ns": "int"}
    return rows.withColumn("path", resolved(F.col("path"))).select(*[F.col(c).cast(kinds[c]) if c in kinds else c for c in [*KEY, "seq", "snap_id", *READING]])


def keep_listings(entries: DataFrame, sequence: DataFrame, path: str) -> DataFrame:
    """Write the listings of ``sequence`` to ``path`` as a store, and return it: each range
    of (root, path) is one file, sorted by file, sequence number, and order of reading.

    One root's files lie in many ranges, however large the root; one file's readings lie in
    one. Repeated readings are kept: the merge passes over them.
    """
    ranges = readings(entries, sequence).repartitionByRange(*KEY)
    order = [F.asc_nulls_first(c) for c in [*KEY, "seq", *READING]]
    ranges.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    return whole_files(entries.sparkSession).read.schema(ranges.schema).parquet(path)


def open_listings(spark: SparkSession, path: str) -> DataFrame:
    """A kept store; each of its files is read by one task, from its beginning to its end."""
    return whole_files(spark).read.parquet(path)


def latest_listings(entries: DataFrame) -> DataFrame:
    """(root_ord, path, seq, snap_id, len, mtime): one row per file and snapshot, of any
    readings: the one with the greatest seen_at counts (a null seen_at is the least; of
    equal ones the greatest len, then mtime)."""
    mtime = F.when(F.col("mtime_s").isNotNull() | F.col("mtime_ns").isNotNull(), F.struct("mtime_s", "mtime_ns"))
    rows = entries.select(*KEY, "seq", "snap_id", F.struct("seen_at", "len", mtime.alias("mtime")).alias("reading"))
    return rows.groupBy(*KEY, "seq", "snap_id").agg(F.max("reading").alias("reading")).select(*KEY, "seq", "snap_id", "reading.len", "reading.mtime")


def _follows(*columns: pa.Array) -> np.ndarray:
    """For each row but the first, if it equals the one before it; nulls are equal."""
    out = np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        out &= pc.or_(both, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)
    return out


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """The events of whole files' rows: each row is held against the one before it, and the
    one after. What a snapshot holds and the next lacks is removed in the next."""
    col = lambda n: rows.column(n).combine_chunks()
    seq = col("seq").to_numpy()
    again = np.append(_follows(col("root_ord"), col("path")) & (np.diff(seq) == 0), False)
    if again.any():
        rows = rows.filter(pa.array(~again))
        seq = col("seq").to_numpy()
    root, path = col("root_ord"), col("path")
    next_to = _follows(root, path) & (np.diff(seq) == 1)
    had, has = np.concatenate(([False], next_to)), np.append(next_to, False)
    same = np.concatenate(([True], _follows(col("len"), col("mtime_s"), col("mtime_ns"))))
    added, changed, removed = (seq > 1) & ~had, had & ~same, ~has
    at = [np.flatnonzero(x) for x in (added, changed, removed)]
    rows_at = pa.array(np.concatenate(at))
    kind = np.repeat(np.array(["added", "changed", "removed"], object), [len(x) for x in at])
    when = np.concatenate((seq[at[0]], seq[at[1]], seq[at[2]] + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([root.take(rows_at), path.take(rows_at), pa.array(when), pa.array(kind, pa.string())], names=EVENTS.names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through a sorted range: of what has come, all but the last file's rows is
    compared and let go."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
        held = held.combine_chunks()
        col = lambda n: held.column(n).combine_chunks()  # noqa: E731,B023
        new = np.flatnonzero(~_follows(col("root_ord"), col("path")))
        if len(new):
            cut = int(new[-1]) + 1
            yield _compared(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield _compared(held)


def consecutive_changes(store: DataFrame, sequence: DataFrame) -> DataFrame:
    """(snap_id, path, change): ``added``, ``removed`` or ``changed`` (len or mtime, null
    equal to null only) in each snapshot of ``sequence`` against the one numbered before it.

    ``store`` is sorted by (root, path), then by sequence number, each range in one task:
    each range is streamed once, and nothing of it is moved. A file's row of one snapshot
    meets its row of the snapshot before, which is the two-pointer merge of each pair of
    consecutive snapshots, all pairs in one pass. A root's first snapshot has no changes;
    an empty listing removes all and adds nothing.
    """
    ids = sequence.select(F.col("root_ord").alias("_root"), F.col("seq").alias("_seq"), "snap_id")
    events = store.select("root_ord", "path", "seq", "len", "mtime_s", "mtime_ns").mapInArrow(_merge, EVENTS)
    return ids.join(events, (F.col("root_ord") == F.col("_root")) & (F.col("at") == F.col("_seq"))).select("snap_id", "path", "change")


def snapshot_changes(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes of each snapshot against the one its root had before: the listings are kept
    first, then merged."""
    spark = entries.sparkSession
    sequence = materialize(in_sequence(snapshots), "sequence")
    return consecutive_changes(keep_listings(entries, sequence, fresh_path(spark, "listings")), sequence)


def refresh_new(ledger: Ledger, entries: DataFrame, snapshots: DataFrame, stamps: DataFrame) -> list[Interval]:
    """Handle the indexed snapshots that ``ledger`` doesn't have as done, and commit their
    rows with the merged intervals of snap_id. Returns what was processed.

    A snapshot indexed late is a gap; it becomes the base of the one after it, which is
    then handled anew. Only the listings of those handled and of their bases are read. The
    output is (snap_id, path), and a row without a path for each snapshot handled, so that
    the last handling counts, rows or none.
    """
    sequence = materialize(processed_sequence(snapshots, stamps), "sequence")

    def work(fresh: DataFrame) -> DataFrame:
        touched = fresh.select("root_ord", F.explode(F.array("seq", F.col("seq") + 1)).alias("seq")).distinct()
        targets = materialize(sequence.join(touched, ["root_ord", "seq"], "left_semi"), "targets")
        read = targets.select("root_ord", F.explode(F.array("seq", F.col("seq") - 1)).alias("seq")).distinct()
        store = keep_listings(entries, sequence.join(read, ["root_ord", "seq"], "left_semi"), fresh_path(fresh.sparkSession, "listings"))
        changes = consecutive_changes(store, targets)
        rows = changes.filter(F.col("change") != "removed").select("snap_id", "path")
        return rows.unionByName(targets.select("snap_id", F.lit(None).cast("string").alias("path")))

    return process_new(ledger, sequence, "snap_id", work)


def refreshed(ledger: Ledger, entries: DataFrame) -> DataFrame:
    """(snap_id, path): what the runs of ``refresh_new`` have committed; of a snapshot
    handled more than once, the last handling."""
    outputs = ledger.read().outputs
    if not outputs:
        return entries.select("snap_id", F.col("path").cast("string")).limit(0)
    spark = ledger.spark
    rows = spark.read.parquet(*outputs)
    if len(outputs) > 1:
        runs = spark.createDataFrame([(o.rsplit("/", 1)[-1], i) for i, o in enumerate(outputs)], "folder string, run int")
        rows = rows.withColumn("folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(runs), "folder")
        last = rows.filter("path IS NULL").groupBy("snap_id").agg(F.max("run").alias("run"))
        rows = rows.join(last, ["snap_id", "run"], "left_semi")
    return rows.filter("path IS NOT NULL").select("snap_id", "path")


def refresh_rows(entries: DataFrame, snapshots: DataFrame, stamps: DataFrame) -> DataFrame:
    """(snap_id, path): for each indexed snapshot, the files that a refresh must handle:
    new, or differing, against the listing indexed last before it. Snapshots that were
    never indexed are neither base nor target, so that failed runs skip nothing and
    repeated ones add nothing. The first indexed snapshot of a root has no base.

    It is one run of ``refresh_new`` over a ledger that has nothing done yet."""
    spark = entries.sparkSession
    ledger = Ledger(spark, fresh_path(spark, "refresh"))
    refresh_new(ledger, entries, snapshots, stamps)
    return refreshed(ledger, entries)
