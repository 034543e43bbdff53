"""Trigrams of texts: every three bytes in a row, packed into an integer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of what is indexed, and the reasons given beyond them.
MAX_FILE_BYTES = 1 << 30
MAX_LINE_BYTES = 2000
MAX_TRIGRAMS = 20_000
BINARY, INVALID, LONG_LINE, TOO_MANY, UNREADABLE = "binary", "invalid UTF-8", "line too long", "too many trigrams", "unreadable"


def packed(content: bytes) -> np.ndarray:
    """All trigrams, in order."""
    b = np.frombuffer(content, np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else np.zeros(0, np.int32)


def distinct_trigrams(content: bytes) -> np.ndarray:
    return np.unique(packed(content))


def analyze(content: bytes | None, max_line: int = MAX_LINE_BYTES, max_trigrams: int = MAX_TRIGRAMS) -> tuple[str | None, np.ndarray | None]:
    """Why ``content`` isn't indexed, or its distinct trigrams in ascending order."""
    if content is None:
        return UNREADABLE, None
    if b"\0" in content:
        return BINARY, None
    try:
        content.decode()
    except UnicodeDecodeError:
        return INVALID, None
    if len(content) > max_line:
        ends = np.flatnonzero(np.frombuffer(content, np.uint8) == 10)
        if np.diff(ends, prepend=-1, append=len(content)).max() - 1 > max_line:
            return LONG_LINE, None
    grams = distinct_trigrams(content)
    return (TOO_MANY, None) if len(grams) > max_trigrams else (None, grams)


def _analyzer(max_line: int, max_trigrams: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons, grams, sizes = [], [], []
            for content in batch.column(1).to_pylist():
                reason, found = analyze(content, max_line, max_trigrams)
                reasons.append(reason)
                grams.append(found if found is not None else np.zeros(0, np.int32))
                sizes.append(len(content) if content is not None else 0)
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*grams, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reasons, pa.string()), pa.array(sizes, pa.int64()), lists], names=["key", "reason", "n_bytes", "grams"])

    return run


def analyzed(df: DataFrame, key: str, content: str, max_line: int = MAX_LINE_BYTES, max_trigrams: int = MAX_TRIGRAMS) -> DataFrame:
    """(key, reason, n_bytes, grams): per row either a reason, or the distinct trigrams.
    A null content is unreadable; contents of fewer than three bytes have no trigrams."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("reason", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("grams", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(_analyzer(max_line, max_trigrams), schema).withColumnRenamed("key", key)


#: Postings put together at a time, and ids in one list at most.
GROUPED, LISTED = 4_000_000, 1 << 16


def _grouped(ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray, listed: int) -> pa.RecordBatch:
    """Lists of ascending ids per trigram."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    code = np.sort(grams.astype(np.int64) << 32 | np.repeat(rank, sizes))
    grams, owner = (code >> 32).astype(np.int32), ids[order][code & 0xFFFFFFFF]
    new = np.flatnonzero(np.diff(grams, prepend=-1))
    n = np.diff(np.append(new, len(grams)))
    if len(n) and n.max() > listed:
        new = np.concatenate([np.arange(a, a + k, listed) for a, k in zip(new, n)])
    cuts = np.append(new, len(grams)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(owner, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(grams[new], pa.int32()), pa.array(owner[new], pa.int64()), pa.array(np.diff(cuts), pa.int32()), lists], names=["trigram", "first", "n", "ids"])


def _lister(grouped: int, listed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
            grams = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            made = _grouped(ids, sizes, grams, listed)
            for at in range(0, made.num_rows, 20_000):
                yield made.slice(at, 20_000)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(1).flatten())
            if size >= grouped:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


LISTS = T.StructType([T.StructField("trigram", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def posting_lists(grams: DataFrame, key: str, grouped: int = GROUPED, listed: int = LISTED) -> DataFrame:
    """(trigram, first, n, ids): of (key, grams), lists of at most ``listed`` ascending keys.

    Each task puts its own texts' postings together first, ``grouped`` at a time, so that
    what is moved is lists, far fewer than postings; a trigram that a third of all texts
    hold has many lists. Rows without a key or without trigrams give nothing.
    """
    rows = grams.filter(F.col(key).isNotNull() & (F.size("grams") > 0)).select(F.col(key).cast("long"), "grams")
    return rows.mapInArrow(_lister(grouped, listed), LISTS)


def skip_reason(content: Column, max_line: int = MAX_LINE_BYTES) -> Column:
    """The reason as a column of built-ins, but for the number of trigrams. In the order
    of precedence; null where nothing speaks against the content."""
    raw = content.cast("binary")
    text = raw.cast("string")
    longest = F.array_max(F.transform(F.split(text, "\n", -1), F.octet_length))
    return (
        F.when(content.isNull(), F.lit(UNREADABLE))
        .when(F.call_function("position", F.lit(b"\0"), raw) > 0, F.lit(BINARY))
        .when(~F.is_valid_utf8(text), F.lit(INVALID))
        .when(longest > max_line, F.lit(LONG_LINE))
    )


def trigram_array(content: Column) -> Column:
    """The distinct trigrams by built-in functions only: half as fast as ``analyzed``,
    but without Python workers."""
    raw = content.cast("binary")
    gram = lambda i: F.conv(F.hex(F.call_function("substring", raw, i, F.lit(3))), 16, 10).cast("int")
    return F.when(F.octet_length(raw) >= 3, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.octet_length(raw) - 2), gram)))).when(content.isNotNull(), F.array().cast("array<int>"))
