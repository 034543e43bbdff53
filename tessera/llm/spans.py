"""Long exact spans shared between records: Rabin-Karp hashes of every window, counted in Spark.

A token is a code point. A window of ``length`` tokens is shared when its text also stands
in another record; the shared tokens of a record are the union of its shared windows, and
its spans are their maximal runs. Counting a row per window would move many times the
input, so windows are counted in three steps, none of which loses one:

1. Every window is named by the least Rabin-Karp hash among the short grams in it, a name
   that depends on the window's text only; neighbouring windows with one name form a run.
   A shared window's name occurs in two records, so runs with other names are done with.
2. A run left over is hashed as a whole. If the whole occurs in two records, so does each
   of its windows. Inside long shared spans this settles nearly all.
3. The windows of the other runs, at the rims of shared spans, are hashed and counted one
   by one, together with those of one run for each settled text of the same name: a window
   at the rim of one record may stand inside a settled run of another.

Counts are a least and a greatest record per hash, which combine map-side: no group is
ever gathered, however many copies a text has. The joins back are on hashes; a hash that a
third of all rows carry is split by the engine's skew handling. Equality is that of 64-bit
hashes of position-weighted, scrambled code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import discard, materialize, spread

LENGTH = 120
#: Short grams name windows. Shorter ones give fewer runs, longer ones fewer chance matches.
GRAM = 48
#: Code points hashed together.
PIECE = 1 << 19
#: A run lies within a piece, so its length takes this many bits beside its beginning.
_SPAN_BITS = 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        n = 2 * PIECE + 2
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes of any stretch of a text of at most 2 * PIECE code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        up, self.down = _powers()
        terms = _scramble(points + np.uint64(0x51ED27)) * up[: len(points)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _scramble((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _scramble((self.sums[k:] - self.sums[:-k]) * self.down[:n] + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _gathered(texts: list[str | None], length: int) -> Iterator[tuple[str, list[tuple[int, int, int, int]]]]:
    """Texts put together to about PIECE code points, longer ones cut so that each window
    lies whole in one piece: (joined, [(text number, place in it, place joined, size)])."""
    parts: list[str] = []
    marks: list[tuple[int, int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text or "") - length + 1, 0), PIECE):
            piece = text[at : at + PIECE + length - 1]
            if size and size + len(piece) > PIECE + length:
                yield "".join(parts), marks
                parts, marks, size = [], [], 0
            marks.append((i, at, size, len(piece)))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield "".join(parts), marks


def _runs(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for joined, marks in _gathered(batch.column(1).to_pylist(), length):
                name = _sliding_min(Rolling(joined).every(gram), length - gram + 1)
                own, offset, place, size = (np.array(x, np.int64) for x in zip(*marks))
                first = np.concatenate(([True], name[1:] != name[:-1]))
                first[place] = True
                valid = np.zeros(len(name) + 1, np.int32)
                np.add.at(valid, place, 1)
                np.add.at(valid, place + size - length + 1, -1)
                inside = np.cumsum(valid)[:-1] > 0
                first[1:] |= inside[1:] != inside[:-1]
                at = np.flatnonzero(first)
                last = np.append(at[1:], len(name)) - 1
                keep = inside[at]
                at, last = at[keep], last[keep]
                mark = np.searchsorted(place, at, side="right") - 1
                shift = offset[mark] - place[mark]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own[mark])), pa.array(name[at].view(np.int64)), pa.array(at + shift), pa.array(last + shift)], names=["key", "name", "lo", "hi"])

    return run


def _wholes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each run with its hash as a whole and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, runs = batch.column(1)[k].as_py(), batch.column(2)[k].values
                name, at = (runs.field(f).to_numpy() for f in (0, 1))
                lo = at >> _SPAN_BITS
                hi = lo + (at & ((1 << _SPAN_BITS) - 1))
                for a in range(0, len(lo), 4096):
                    pieces = [text[x : y + length] for x, y in zip(lo[a : a + 4096].tolist(), hi[a : a + 4096].tolist())]
                    joined = "".join(pieces)
                    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                    ends = np.cumsum(sizes)
                    if len(joined) <= 2 * PIECE:
                        whole = Rolling(joined).between(ends - sizes, ends)
                    else:
                        whole = np.concatenate([Rolling(p).between(np.zeros(1, np.int64), np.array([len(p)])) for p in pieces])
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(k, 1)] * n), pa.array(name[a : a + 4096]), pa.array(lo[a : a + 4096]), pa.array(hi[a : a + 4096]), pa.array(whole.view(np.int64)), pa.array(pieces, pa.string())], names=["key", "name", "lo", "hi", "whole", "text"])

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(3).to_numpy()
            for joined, marks in _gathered(batch.column(4).to_pylist(), length):
                hashes = Rolling(joined)
                own, offset, place, size = (np.array(x, np.int64) for x in zip(*marks))
                n = size - length + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(place, n) + step
                who = np.repeat(own, n)
                whose = [batch.column(c).take(pa.array(who)) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*whose, pa.array(low[who] + np.repeat(offset, n) + step), pa.array(hashes.between(at, at + length).view(np.int64))], names=["key", "a", "b", "lo", "hash"])

    return run


def _in_two_records(rows: DataFrame, by: str, least: str = "key", greatest: str = "key") -> DataFrame:
    """The values of ``by`` that two different records carry, with two such records."""
    return rows.groupBy(by).agg(F.min(least).alias("a"), F.max(greatest).alias("b")).filter("a <> b")


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, span_start, span_end): each longest run of shared code points, end exclusive.

    Rows with a null key are left out; null texts and texts shorter than ``length`` share
    nothing; rows with the same key are one record and don't share with each other.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram is no longer than a window")
    kind = T.StructField("key", df.schema[key].dataType)
    docs = df.filter(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    runs = materialize(spread(docs).mapInArrow(_runs(length, gram), T.StructType([kind, *long("name", "lo", "hi")])), "span-runs")
    named = _in_two_records(runs, "name").select("name")
    packed = runs.select("name", "key", (F.shiftleft("lo", _SPAN_BITS) + F.col("hi") - F.col("lo")).alias("at"))
    near = materialize(packed.join(named, "name", "left_semi").groupBy("key").agg(F.collect_list(F.struct("name", "at")).alias("runs")), "span-near")
    discard(runs)
    pieces = docs.join(near, "key").select("key", "text", "runs").mapInArrow(_wholes(length), T.StructType([kind, *long("name", "lo", "hi", "whole"), T.StructField("text", T.StringType())]))
    pieces = materialize(pieces, "span-pieces")
    discard(near)
    tagged = materialize(pieces.join(_in_two_records(pieces, "whole"), "whole", "left").drop("whole"), "span-wholes")
    discard(pieces)
    settled = tagged.filter("a IS NOT NULL").select("key", "lo", "hi")
    rims = tagged.filter("a IS NULL").select("key", F.col("key").alias("a"), F.col("key").alias("b"), "lo", "text", "name")
    inner = tagged.filter("key = a").select(F.lit(None).cast(kind.dataType).alias("key"), "a", "b", "lo", "text", "name")
    inner = inner.join(rims.select("name").distinct(), "name", "left_semi").select(rims.columns)
    pairs = [T.StructField(n, kind.dataType) for n in ("a", "b")]
    windows = rims.unionByName(inner).drop("name").mapInArrow(_windows(length), T.StructType([kind, *pairs, *long("lo", "hash")]))
    windows = materialize(windows, "span-windows")
    counted = _in_two_records(windows, "hash", "a", "b").select("hash")
    single = windows.filter(F.col("key").isNotNull()).join(counted, "hash", "left_semi").select("key", "lo", F.col("lo").alias("hi"))
    by = W.partitionBy("key").orderBy("lo")
    reach = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    parts = materialize(settled.unionByName(single).select("key", "lo", (F.col("hi") + length).alias("stop")), "span-parts")
    discard(tagged)
    discard(windows)
    island = F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    merged = parts.withColumn("reach", reach).withColumn("island", island).groupBy("key", "island").agg(F.min("lo").alias("span_start"), F.max("stop").alias("span_end"))
    return merged.select(F.col("key").alias(key), "span_start", "span_end")


def shared_share(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_chars, shared_chars, share): how much of each record stands elsewhere too.
    Null texts have 0 characters; the share of an empty text is 0."""
    per = shared_spans(df, key, text, length).groupBy(F.col(key).alias("_k")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    rows = df.select(F.col(key).alias(key), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.coalesce(F.col("shared_chars"), F.lit(0).cast("long"))
    share = F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0))
    return rows.join(per, F.col(key) == F.col("_k"), "left").select(key, "n_chars", shared.alias("shared_chars"), share.alias("share"))
