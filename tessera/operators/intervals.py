"""Processing only new or changed records: sequence numbers kept as disjoint intervals.

A ledger holds the sequence numbers whose output is committed, as disjoint, merged
intervals. A run subtracts them from the numbers available, processes the gaps (a late
commit is just another gap), writes its output under a new folder, and then creates the
next commit record, which names the merged intervals and the output folder. Only numbers
outside the intervals done are looked at: what is done is passed over by the scan, by the
ranges of its files and row groups, and is neither sorted nor moved. A run that dies before its record leaves a folder nobody reads; a run that is
repeated finds nothing left. Two runs at once: the record is created only if absent, so
one of them wins and the other reports a conflict.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.runtime import SharedFolder

Interval = tuple[int, int]


def merged(parts: Iterable[Interval]) -> list[Interval]:
    """Closed integer intervals as the fewest disjoint ones; neighbours join."""
    out: list[list[int]] = []
    for lo, hi in sorted(p for p in parts if p[0] <= p[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def gaps(available: Iterable[Interval], done: Iterable[Interval]) -> list[Interval]:
    """What ``available`` holds and ``done`` does not: one pass over both."""
    left: list[Interval] = []
    finished = merged(done)
    at = 0
    for lo, hi in merged(available):
        while at < len(finished) and finished[at][1] < lo:
            at += 1
        k = at
        while lo <= hi and k < len(finished) and finished[k][0] <= hi:
            a, b = finished[k]
            if a > lo:
                left.append((lo, a - 1))
            lo = b + 1
            k += 1
        if lo <= hi:
            left.append((lo, hi))
        at = max(at, k - 1)
    return left


def islands(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """The runs of consecutive ``seq`` per ``group``: (group, lo, hi). Nulls are left
    out; repeated numbers count once."""
    numbered = rows.select(group, seq).dropna().distinct().withColumn("_k", F.col(seq) - F.row_number().over(W.partitionBy(group).orderBy(seq)))
    return numbered.groupBy(group, "_k").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).drop("_k")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of consecutive numbers in a task's ascending, distinct ones."""
    low = last = None
    for batch in batches:
        x = batch.column(0).to_numpy()
        if not len(x):
            continue
        if low is None:
            low = last = int(x[0])
        breaks = np.flatnonzero(np.diff(x, prepend=last) > 1)
        lows = np.concatenate(([low], x[breaks]))
        highs = np.append(np.concatenate(([last], x))[breaks], x[-1])
        if len(breaks):
            yield pa.RecordBatch.from_arrays([pa.array(lows[:-1], pa.int64()), pa.array(highs[:-1], pa.int64())], names=["lo", "hi"])
        low, last = int(lows[-1]), int(x[-1])
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([last], pa.int64())], names=["lo", "hi"])


def available(rows: DataFrame, seq: str, most: int | None = None) -> list[Interval]:
    """The numbers present, as intervals; the lowest ``most`` of them if there are more.
    Numbers are sorted in ranges, each range is read once, and only the ends of its runs
    come to the driver, which joins those that touch."""
    numbers = rows.select(F.col(seq).cast("long").alias("seq")).dropna().distinct()
    ends = numbers.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_runs, "lo long, hi long")
    if most is not None:
        ends = ends.orderBy("lo").limit(most)
    found = ends.toArrow()
    return merged(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Ranges that a scan is given.
RANGES = 32
#: Gaps handled in one pass: what comes to the driver, and goes to each task, 16 bytes each.
GAPS = 1 << 20


def within(rows: DataFrame, seq: str, parts: Iterable[Interval]) -> DataFrame:
    """The rows whose number lies in ``parts``. At most ``RANGES`` ranges, cut at the widest
    distances, reach the scan; what else lies between is told by a binary search."""
    parts = merged(parts)
    if not parts:
        return rows.filter("false")
    lo, hi = np.array(parts, np.int64).T
    cuts = np.sort(np.argsort(lo[1:].astype(float) - hi[:-1].astype(float), kind="stable")[::-1][: RANGES - 1]) + 1
    wide = [(int(a[0]), int(b[-1])) for a, b in zip(np.split(lo, cuts), np.split(hi, cuts))]
    edge = lambda a, b: " AND ".join([f"`{seq}` >= {a}L"] * (a != LOWEST) + [f"`{seq}` <= {b}L"] * (b != HIGHEST)) or "true"
    near = rows.filter(f"`{seq}` IS NOT NULL AND ({' OR '.join(f'({edge(a, b)})' for a, b in wide)})")
    if len(parts) <= RANGES:
        return near
    sent = rows.sparkSession.sparkContext.broadcast((lo, hi))

    @F.pandas_udf("boolean")
    def inside(numbers: pd.Series) -> pd.Series:
        low, high = sent.value
        at = np.searchsorted(low, numbers.to_numpy(), side="right") - 1
        return pd.Series((at >= 0) & (numbers.to_numpy() <= high[np.maximum(at, 0)]))

    return near.filter(inside(F.col(seq).cast("long")))


class LedgerConflict(RuntimeError):
    """Another run committed first."""


@dataclass(frozen=True)
class Commit:
    version: int
    done: tuple[Interval, ...]
    outputs: tuple[str, ...]


class Ledger:
    """Commit records ``commit-N.json`` in a shared folder. Each names the intervals done and
    its own output; one in ``WHOLE`` names all outputs, so that few records are read."""

    WHOLE = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = SharedFolder(spark, path)

    def read(self) -> Commit:
        names = sorted(n for n in self._folder.names() if n.startswith("commit-"))
        if not names:
            return Commit(0, (), ())
        last = body = json.loads(self._folder.read(names[-1]))
        outputs: list[str] = []
        for name in reversed(names[:-1]):
            if "before" in body:
                break
            outputs[:0] = body["outputs"]
            body = json.loads(self._folder.read(name))
        outputs[:0] = [*body.get("before", []), *body["outputs"]]
        return Commit(int(names[-1][7:-5]), tuple((lo, hi) for lo, hi in last["done"]), tuple(outputs))

    def commit(self, base: Commit, processed: list[Interval], output: str | None) -> Commit:
        own = (output,) if output else ()
        after = Commit(base.version + 1, tuple(merged([*base.done, *processed])), base.outputs + own)
        body = {"done": after.done, "outputs": own} | ({"before": base.outputs} if after.version % self.WHOLE == 0 else {})
        if not self._folder.create(f"commit-{after.version:08d}.json", json.dumps(body)):
            raise LedgerConflict(f"{self.path}: commit {after.version} exists")
        return after

    def output(self) -> DataFrame | None:
        """All committed output; None before the first commit that has any."""
        at = self.read().outputs
        return self.spark.read.parquet(*at) if at else None


def process_new(ledger: Ledger, source: DataFrame, seq: str, work: Callable[[DataFrame], DataFrame], most: int = GAPS) -> list[Interval]:
    """Run ``work`` over the rows of ``source`` whose sequence number isn't done, and
    commit its output with their intervals. Returns what was processed.

    The ranges open are all numbers less those done; the numbers available there, less
    those done, are the gaps. Only the ends of runs of new numbers come to the driver, at
    most ``most`` at a time: if there are more, they are handled in as many passes, each
    with its own commit. Rows without a sequence number are never available.
    """
    handled: list[Interval] = []
    while True:
        base = ledger.read()
        fresh = within(source, seq, gaps([(LOWEST, HIGHEST)], base.done))
        todo = gaps(available(fresh, seq, most), base.done)
        if not todo:
            return merged(handled)
        out = f"{ledger.path}/out-{uuid.uuid4().hex}"
        work(within(source, seq, todo)).write.parquet(out)
        ledger.commit(base, todo, out)
        handled += todo


def indexed_snapshots(snapshots: DataFrame, stamps: DataFrame) -> DataFrame:
    """Snapshots with a stamp of their own that carries their fingerprint, hex case
    aside. Null fingerprints match nothing; repeated stamps count once."""
    marks = stamps.select("snap_id", F.lower("fingerprint").alias("_fp")).dropna().distinct()
    return snapshots.withColumn("_fp", F.lower("fingerprint")).join(marks, ["snap_id", "_fp"], "left_semi").drop("_fp")


def in_sequence(snapshots: DataFrame) -> DataFrame:
    """(snap_id, root_ord, seq): snapshots numbered 1.. per root by taken_at; ties fall
    to snap_id, and a snapshot without a time comes first."""
    w = W.partitionBy("root_ord").orderBy(F.col("taken_at").asc_nulls_first(), "snap_id")
    return snapshots.select("snap_id", "root_ord", "taken_at").withColumn("seq", F.row_number().over(w)).drop("taken_at")


def processed_sequence(snapshots: DataFrame, stamps: DataFrame) -> DataFrame:
    """(snap_id, root_ord, seq): the indexed snapshots, renumbered without holes.

    Every snapshot has its number in its root's sequence; those indexed form disjoint
    intervals; a number's new place is the length of the intervals before its own plus
    its offset there. So the listing last indexed before any number is the place before.
    """
    every = in_sequence(snapshots)
    done = every.join(indexed_snapshots(snapshots, stamps).select("snap_id"), "snap_id", "left_semi")
    before = W.partitionBy("root_ord").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    spans = islands(done, "root_ord", "seq").withColumn("before", F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(before), F.lit(0)))
    spans = spans.withColumnRenamed("root_ord", "_root")
    inside = (F.col("root_ord") == F.col("_root")) & F.col("seq").between(F.col("lo"), F.col("hi"))
    return done.join(spans, inside).select("snap_id", "root_ord", (F.col("before") + F.col("seq") - F.col("lo") + 1).cast("int").alias("seq"))
