"""Evaluating a boolean trigram query over postings, and reading only what it leaves.

Postings are rows (trigram, key), or lists (trigram, ids). How many files hold each trigram
bounds what a query can leave before any posting is read; the way of reading follows from
that bound alone, and each way gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.boolquery import ALL, AND, NONE, OR, Query
from tessera.runtime import materialize

_WORD = 63
#: A trigram held by at most this many files is rare enough to be sent to every task.
RARE_FILES = 1_000_000
#: A search that at most this many files can satisfy names them in its scan.
FEW_FILES = 4096
#: Postings that the driver may put together itself, 8 bytes each.
FEW_POSTINGS = 1 << 18
#: A search that more than a share of one in so many files may satisfy reads them all.
SCAN_SHARE = 8
#: Ranges of ids that a scan is given, beside the ids.
RANGES = 32


class GramCounts:
    """How many files hold each trigram, looked up on the driver. There are at most 2^24
    trigrams, so this takes at most 200 MB however large the collection."""

    def __init__(self, counts: DataFrame):
        self.table = counts
        self._known: tuple[np.ndarray, np.ndarray] | None = None

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self._known is None:
            got = self.table.select(F.col("trigram").cast("int"), F.col("n_files").cast("long")).toArrow()
            grams, n = (got.column(i).to_numpy() for i in (0, 1))
            order = np.argsort(grams)
            self._known = grams[order], n[order]
        return self._known

    def __len__(self) -> int:
        return len(self._arrays()[0])

    def of(self, gram: int) -> int:
        grams, n = self._arrays()
        at = int(np.searchsorted(grams, gram))
        return int(n[at]) if at < len(grams) and grams[at] == gram else 0

    def ceiling(self, q: Query, total: int) -> int:
        """The most files that can satisfy ``q``, of ``total``."""
        if q.kind in (ALL, NONE):
            return total if q.kind == ALL else 0
        each = [self.of(g) for g in q.grams] + [self.ceiling(p, total) for p in q.parts]
        return min([total, *each]) if q.kind == AND else min(total, sum(each))

    def slimmed(self, q: Query, spare: int = 32) -> Query:
        """A query that every file satisfying ``q`` satisfies too, without those trigrams
        of conjunctions that are far more frequent than their rarest: reading their
        postings costs more than the files that they would rule out."""
        parts = tuple(self.slimmed(p, spare) for p in q.parts)
        if q.kind != AND or not q.grams:
            return Query(q.kind, q.grams, parts)
        least = min(self.of(g) for g in q.grams)
        return Query(AND, frozenset(g for g in q.grams if self.of(g) <= max(least * spare, 1024)), parts)


def _test(q: Query, place: dict[int, int]) -> Column:
    parts = [F.getbit(F.col(f"b{place[g] // _WORD}"), F.lit(place[g] % _WORD)) == 1 for g in sorted(q.grams)] + [_test(p, place) for p in q.parts]
    if q.kind in (ALL, NONE) or not parts:
        return F.lit(q.kind in (ALL, AND))
    return reduce(lambda a, b: a & b if q.kind == AND else a | b, parts)


def _one_of(column: str, values: Iterable[int]) -> str:
    return f"`{column}` IN ({', '.join(map(str, sorted(values)))})"


def _rows(postings: DataFrame, grams: Iterable[int], key: str) -> DataFrame:
    """(trigram, key) of the given trigrams, by a filter that reaches the scan."""
    kept = postings.filter(_one_of("trigram", grams))
    return kept.select("trigram", F.explode("ids").alias(key)) if "ids" in postings.columns else kept.select("trigram", key)


def candidates(postings: DataFrame, q: Query, files: DataFrame, counts: GramCounts | DataFrame | None = None, key: str = "file_id", rare_files: int = RARE_FILES) -> DataFrame:
    """(key): the files whose trigrams satisfy ``q``, each once.

    Postings of the query's trigrams are read, folded into one bit per trigram and file
    (combining map-side), and the query is a test of bits. With ``counts`` (trigram,
    n_files), what no file can satisfy reads nothing, and a conjunction's rarest trigram,
    if it is rare enough to broadcast, first cuts the others' postings down to its files.
    """
    if isinstance(counts, DataFrame):
        counts = GramCounts(counts)
    nobody = files.select(key).filter(F.lit(False))
    if q.kind == NONE:
        return nobody
    leaves = sorted(set(q.leaves()))
    if q.kind == ALL or not leaves or _always(q):
        return files.select(key).distinct()
    if counts is not None and counts.ceiling(q, 1) == 0:
        return nobody
    rows = _rows(postings, leaves, key)
    if counts is not None and q.kind == AND and q.grams:
        rarest = min(q.grams, key=counts.of)
        if counts.of(rarest) <= rare_files and len(leaves) > 1:
            rows = rows.join(F.broadcast(_rows(postings, [rarest], key).select(key)), key, "left_semi")
    place = {g: i for i, g in enumerate(leaves)}
    at = F.array_position(F.array(*map(F.lit, leaves)), F.col("trigram")) - 1
    rows = rows.select(key, at.cast("int").alias("at"))
    words = range((len(leaves) + _WORD - 1) // _WORD)
    bit = lambda w: F.when(F.floor(F.col("at") / _WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") - w * _WORD)).otherwise(F.lit(0).cast("long"))
    held = rows.groupBy(key).agg(*[F.bit_or(bit(w)).alias(f"b{w}") for w in words])
    return held.filter(_test(q, place)).select(key)


def _always(q: Query) -> bool:
    """True for queries that even a file without trigrams satisfies."""
    return q.holds(set())


def _put_together(q: Query, lists: dict[int, np.ndarray]) -> np.ndarray:
    """The ids that satisfy ``q``, of sorted lists of each of its trigrams."""
    each = sorted([lists.get(g, np.zeros(0, np.int64)) for g in q.grams] + [_put_together(p, lists) for p in q.parts], key=len)
    if not each:
        return np.zeros(0, np.int64)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), each) if q.kind == AND else np.unique(np.concatenate(each))


@dataclass(frozen=True)
class Chosen:
    """What a search has to read: all files; those of a list; or those of a table."""

    everything: bool = False
    ids: np.ndarray | None = None
    table: DataFrame | None = None
    small: bool = False

    def of(self, rows: DataFrame, key: str) -> DataFrame:
        """Those of ``rows``. A list of ids reaches the scan as ranges and as a list, so
        that row groups and pages without any of them are passed over; of an empty list
        nothing is read at all."""
        if self.everything:
            return rows
        if self.ids is not None:
            return rows.filter(among(key, self.ids))
        return rows.join(F.broadcast(self.table) if self.small else self.table, key, "left_semi")


def ranges_of(ids: np.ndarray, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that together hold the sorted ``ids``, cut at the widest gaps."""
    if not len(ids):
        return []
    cuts = np.sort(np.argsort(np.diff(ids), kind="stable")[::-1][: most - 1]) + 1
    return [(int(part[0]), int(part[-1])) for part in np.split(ids, cuts)]


def among(key: str, ids: np.ndarray) -> str:
    if not len(ids):
        return "false"
    spans = " OR ".join(f"`{key}` BETWEEN {lo} AND {hi}" for lo, hi in ranges_of(ids))
    return f"({spans}) AND {_one_of(key, ids.tolist())}"


def choose(postings: DataFrame, q: Query, files: Callable[[], DataFrame], counts: GramCounts, total: int, key: str = "file_id", few: int = FEW_FILES, exact: bool = False) -> Chosen:
    """How the files that may match are read, chosen by the most there can be of them:

    none: nothing is read; up to ``few``: their ids are named in the scan (their postings,
    if few as well, are put together on the driver, else in the engine); up to one in
    ``SCAN_SHARE``: a table of their ids, written once, and a semi join, whose right side
    is broadcast up to ``RARE_FILES`` ids; beyond that all files are read. If ``exact``, only
    files that satisfy ``q`` are read, however many they are.
    """
    ceiling = 0 if q.kind == NONE else total if q.kind == ALL or _always(q) else counts.ceiling(q, total)
    if ceiling == 0:
        return Chosen(ids=np.zeros(0, np.int64))
    if q.kind == ALL or _always(q) or not exact and ceiling > few and ceiling * SCAN_SHARE > total:
        return Chosen(everything=True)
    slim = q if exact else counts.slimmed(q)
    if ceiling > few:
        return Chosen(table=materialize(candidates(postings, slim, files(), counts, key), "candidates"), small=ceiling <= RARE_FILES)
    leaves = set(slim.leaves())
    if "ids" in postings.columns and sum(map(counts.of, leaves)) <= FEW_POSTINGS:
        got = postings.filter(_one_of("trigram", leaves)).select("trigram", "ids").toArrow()
        held: dict[int, list[np.ndarray]] = {}
        for gram, ids in zip(got.column(0).to_pylist(), got.column(1)):
            held.setdefault(gram, []).append(ids.values.to_numpy())
        return Chosen(ids=_put_together(slim, {g: np.sort(np.concatenate(x)) for g, x in held.items()}))
    found = candidates(postings, slim, files(), counts, key).toArrow().column(0).to_numpy()
    return Chosen(ids=np.sort(found))


__all__ = ["ALL", "OR", "Chosen", "GramCounts", "among", "candidates", "choose", "ranges_of"]
