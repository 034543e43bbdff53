"""A trigram index as a folder of tables, replaced as a whole and read under concurrency.

``<path>/v-<id>/`` holds the tables of one build; ``<path>/current-N.json`` names the build
that counts and what it holds. A build is written first and named last, so that readers
have either the old one or the new one, and a failed build changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import trigrams
from tessera.functions.trigrams import UNREADABLE, analyzed
from tessera.operators import grep
from tessera.plans.analyze import regexp_query
from tessera.plans.boolquery import EVERYTHING, Query
from tessera.plans.candidates import Chosen, GramCounts, candidates, choose
from tessera.runtime import SharedFolder, materialize

FAMILY, VERSION = "tessera trigram index", 2
KEEP_BUILDS = 2

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
TABLES = {
    "roots": T.StructType([T.StructField("root_ord", _I), T.StructField("path", _S), T.StructField("source", _S)]),
    "files": T.StructType([T.StructField("file_id", _L), T.StructField("root_ord", _I), T.StructField("path", _S), T.StructField("n_bytes", _L)]),
    "postings": trigrams.LISTS,
    "gram_counts": T.StructType([T.StructField("trigram", _I), T.StructField("n_files", _L)]),
    "skips": T.StructType([T.StructField("root_ord", _I), T.StructField("path", _S), T.StructField("reason", _S)]),
}


class IndexFormatError(ValueError):
    """The folder holds no index this version reads, or a damaged one."""


@dataclass(frozen=True)
class Stats:
    files_seen: int
    files_indexed: int
    files_skipped: int
    bytes_indexed: int
    distinct_trigrams: int
    posting_entries: int
    index_bytes: int


def dense_ids(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with dense numbers from 0 in a total order, without bringing all rows to
    one task: they are sorted in ranges and written; then each range is shifted by the
    sizes of those before it (a row per range, broadcast)."""
    keyed = rows.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    names = [f"_o{i}" for i in range(len(order))]
    placed = materialize(keyed.repartitionByRange(*names).sortWithinPartitions(*names).select(rows.columns + [F.monotonically_increasing_id().alias("_at")]), "ordered")
    split = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = split.groupBy("_range").agg((F.max("_in") + 1).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", ahead.alias("_start"))
    return split.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).select(rows.columns + [name])


#: Contents read before they are handed on, in bytes.
READ_BYTES = 32 << 20
#: Postings tables: ids as differences, in pages that a lookup of one trigram reads alone.
STORED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#ids.list.element": "false", "parquet.page.row.count.limit": "2000", "parquet.block.size": str(32 << 20)}
MISSING, DENIED = "missing", "unreadable"


def _read(path: str, opened: dict) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why there are none. Paths with a scheme are read through the file
    system they name; any other must be reachable from the worker."""
    try:
        if "://" not in path:
            with open(path, "rb") as f:
                return f.read(), None
        from pyarrow import fs

        scheme = "/".join(path.split("/", 3)[:3])
        if scheme not in opened:
            opened[scheme] = fs.FileSystem.from_uri(path)[0]
        with opened[scheme].open_input_stream(fs.FileSystem.from_uri(path)[1]) as f:
            return f.read(), None
    except FileNotFoundError:
        return None, MISSING
    except (OSError, pa.ArrowException):
        return None, DENIED


def read_contents(listed: DataFrame, batch_bytes: int = READ_BYTES) -> DataFrame:
    """``listed`` with ``content``, the bytes of each ``path`` as they are now, and ``lost``:
    null, or ``missing`` or ``unreadable`` where there are none. What is read is handed on
    whenever it has ``batch_bytes``, so that a worker holds that and one file more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            contents, lost, size, begun = [], [], 0, 0

            def part(upto: int) -> pa.RecordBatch:
                rows = batch.slice(begun, upto - begun)
                return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary()), pa.array(lost, pa.string())], names=[*batch.schema.names, "content", "lost"])

            for i, path in enumerate(batch.column("path").to_pylist()):
                content, why = (None, MISSING) if path is None else _read(path, opened)
                contents.append(content)
                lost.append(why)
                size += len(content or b"")
                if size >= batch_bytes:
                    yield part(i + 1)
                    contents, lost, size, begun = [], [], 0, i + 1
            if contents:
                yield part(batch.num_rows)

    schema = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("lost", T.StringType())])
    return listed.mapInArrow(run, schema)


def posting_rows(lists: DataFrame, key: str = "file_id") -> DataFrame:
    """(trigram, key): one row per trigram of each indexed text."""
    return lists.select("trigram", F.explode("ids").alias(key))


def gram_counts(lists: DataFrame) -> DataFrame:
    """(trigram, n_files): from the lengths of the lists, without their ids."""
    return lists.groupBy("trigram").agg(F.sum(F.col("n").cast("long")).alias("n_files"))


def sorted_lists(grams: DataFrame, key: str, label: str = "lists") -> DataFrame:
    """The postings of (key, grams) as lists, range-partitioned and sorted by trigram and
    first id: a scan for a few trigrams skips nearly all row groups and pages, and a
    trigram that a third of all texts hold spreads over many ranges."""
    lists = materialize(trigrams.posting_lists(grams, key), label)
    return lists.repartitionByRange("trigram", "first").sortWithinPartitions("trigram", "first")


def posting_blocks(lists: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(trigram, block, cnt, first_id, last_id): each trigram's ids by blocks of equal
    range, put together from the ends and lengths of what each list has in the block."""
    piece = lists.select("trigram", F.explode("ids").alias("id")).withColumn("block", F.floor(F.col("id") / block))
    return piece.groupBy("trigram", "block").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


class Index:
    """One build of an index, opened."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta
        self._chosen: dict[tuple, Chosen] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{self.meta['build']}/{name}")

    @property
    def stats(self) -> Stats:
        return Stats(**self.meta["stats"])

    @property
    def num_files(self) -> int:
        return self.meta["rows"]["files"]

    @property
    def num_trigrams(self) -> int:
        return self.meta["rows"]["gram_counts"]

    def roots(self) -> DataFrame:
        return self.table("roots").orderBy("root_ord")

    def names(self, ids: DataFrame) -> DataFrame:
        """(file_id, path) of the given ids; an id out of range has the empty name."""
        return ids.join(self.table("files").select("file_id", "path"), "file_id", "left").na.fill("", ["path"])

    @cached_property
    def counts(self) -> GramCounts:
        return GramCounts(self.table("gram_counts"))

    def posting_count(self, trigram: int) -> int:
        return self.counts.of(trigram)

    def posting_list(self, trigram: int) -> DataFrame:
        return posting_rows(self.table("postings").filter(F.col("trigram") == trigram)).select("file_id").orderBy("file_id")

    def posting_query(self, query: Query) -> DataFrame:
        """The candidates, in order."""
        return candidates(self.table("postings"), query, self.table("files"), self.counts).orderBy("file_id")

    # Searching

    def candidate_files(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None) -> DataFrame:
        """(file_id, root_ord, path): the files that the index leaves. ``name`` filters
        paths before any content is read."""
        query = EVERYTHING if brute else regexp_query(pattern, ignore_case)
        files = self.table("files").select("file_id", "root_ord", "path")
        if name is not None:
            files = grep.name_filter(files, name)
        if brute:
            return files
        return files.join(candidates(self.table("postings"), query, files, self.counts), "file_id", "left_semi")

    def chosen(self, pattern: str, ignore_case: bool = False, brute: bool = False, table: bool = False) -> Chosen:
        """What a search reads, found once for each expression. Of files (not a ``table``)
        only candidates are read, whatever their share."""
        asked = pattern, ignore_case, brute, table
        if asked not in self._chosen:
            query = EVERYTHING if brute else regexp_query(pattern, ignore_case)
            self._chosen[asked] = choose(self.table("postings"), query, lambda: self.table("files"), self.counts, self.num_files, exact=not table)
        return self._chosen[asked]

    def found_files(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None, table: bool = False) -> DataFrame:
        """(file_id, path): the files that a search opens."""
        files = self.table("files").select("file_id", "path")
        return self.chosen(pattern, ignore_case, brute, table).of(files if name is None else grep.name_filter(files, name), "file_id")

    def texts(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None, contents: DataFrame | None = None) -> DataFrame:
        """(file, lost, text): what a search reads, ``file`` being (file_id, path). Their
        current contents are those of a table (path, content), or of the files."""
        found = self.found_files(pattern, ignore_case, brute, name, contents is not None)
        if contents is None:
            read = read_contents(found.repartition("file_id"))
        else:
            live = contents.select("path", F.col("content").cast("binary").alias("content"), F.lit(True).alias("_there"))
            read = found.join(live, "path", "left").withColumn("lost", F.when(F.col("_there").isNull(), F.lit(MISSING)).when(F.col("content").isNull(), F.lit(DENIED)))
        return read.select(F.struct("file_id", "path").alias("file"), "lost", F.col("content").cast("string").alias("text"))

    def search_lines(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None, contents: DataFrame | None = None) -> DataFrame:
        """(file_id, path, line_no, line) in the order of files and lines."""
        hits = grep.matching_lines(self.texts(pattern, ignore_case, brute, name, contents), pattern, "file", "text", ignore_case)
        return hits.select("file.file_id", "file.path", "line_no", "line").orderBy("file_id", "line_no")

    def search_counts(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None, contents: DataFrame | None = None) -> DataFrame:
        """(file_id, path, n): files with a hit, and their hits."""
        hits = grep.match_counts(self.texts(pattern, ignore_case, brute, name, contents), pattern, "file", "text", ignore_case)
        return hits.select("file.file_id", "file.path", "n").orderBy("file_id")

    def search_files(self, pattern: str, ignore_case: bool = False, brute: bool = False, name: str | None = None, contents: DataFrame | None = None) -> DataFrame:
        """(file_id, path): files with a hit."""
        hits = grep.matching_files(self.texts(pattern, ignore_case, brute, name, contents), pattern, "file", "text", ignore_case)
        return hits.select("file.file_id", "file.path").orderBy("file_id")

    def lost_files(self, found: DataFrame) -> DataFrame:
        """(missing, unreadable): one row counting files that cannot be opened now."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = [None if os.access(p, os.R_OK) else DENIED if os.path.exists(p) else MISSING for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string())], names=["lost"])

        return lost_count(found.select("path").mapInArrow(run, "lost string"))

    def explain_search(self, pattern: str, ignore_case: bool = False, name: str | None = None) -> DataFrame:
        """(query, candidates, files): one row on how a search is planned."""
        shown = str(regexp_query(pattern, ignore_case))
        found = self.candidate_files(pattern, ignore_case, name=name)
        return found.agg(F.count(F.lit(1)).alias("candidates")).select(F.lit(shown).alias("query"), "candidates", F.lit(self.num_files).cast("long").alias("files"))

    # Checking

    def problems(self) -> list[str]:
        """What is wrong with the tables: their columns, row counts, ids out of range,
        repeated postings, counts that don't agree."""
        out = []
        for name, schema in TABLES.items():
            try:
                there = self.spark.read.parquet(f"{self.path}/{self.meta['build']}/{name}")
            except Exception:
                out.append(f"{name} cannot be read")
                continue
            if {(f.name, f.dataType) for f in there.schema} != {(f.name, f.dataType) for f in schema}:
                out.append(f"{name} has other columns")
            else:
                try:
                    rows = there.count()
                except Exception:
                    out.append(f"{name} cannot be read")
                    continue
                if rows != self.meta["rows"].get(name):
                    out.append(f"{name} has {rows} rows, not {self.meta['rows'].get(name)}")
        if out:
            return out
        n = self.num_files
        postings, counts, files = self.table("postings"), self.table("gram_counts"), self.table("files")
        ids = files.agg(F.min("file_id"), F.max("file_id"), F.count_distinct("file_id")).first()
        if n and tuple(ids) != (0, n - 1, n):
            out.append("file ids are not dense")
        rows = posting_rows(postings)
        bad = rows.filter(F.col("file_id").isNull() | (F.col("file_id") < 0) | (F.col("file_id") >= n) | F.col("trigram").isNull() | (F.col("trigram") < 0) | (F.col("trigram") >= 1 << 24))
        if not bad.isEmpty():
            out.append("postings name files or trigrams that cannot be")
        if not postings.filter((F.col("n") != F.size("ids")) | (F.col("first") != F.element_at("ids", 1)) | (F.col("ids") != F.array_sort(F.array_distinct("ids")))).isEmpty():
            out.append("lists of postings are out of order, or not as long as they say")
        if not rows.groupBy("trigram", "file_id").count().filter("count > 1").isEmpty():
            out.append("postings are repeated")
        again = gram_counts(postings).withColumnRenamed("n_files", "n")
        if not counts.join(again, "trigram", "full").filter(~F.col("n").eqNullSafe(F.col("n_files"))).isEmpty():
            out.append("trigram counts do not agree with the postings")
        return out


def lost_count(rows: DataFrame) -> DataFrame:
    """(missing, unreadable): how many of ``rows`` were lost in either way."""
    return rows.agg(F.count_if(F.col("lost") == MISSING).alias("missing"), F.count_if(F.col("lost") == DENIED).alias("unreadable"))


def _records(folder: SharedFolder) -> list[str]:
    return sorted(n for n in folder.names() if n.startswith("current-") and n.endswith(".json"))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_records(SharedFolder(spark, path)))


def open_index(spark: SparkSession, path: str, validate: bool = False) -> Index:
    """The build that counts now. The pointer is read once: a search stays with its build."""
    folder = SharedFolder(spark, path)
    records = _records(folder)
    if not records:
        raise IndexFormatError(f"{path}: not an index; build one first")
    try:
        meta = json.loads(folder.read(records[-1]))
    except ValueError as e:
        raise IndexFormatError(f"{path}: the index's record is damaged; reset it and build anew") from e
    if not isinstance(meta, dict) or meta.get("family") != FAMILY:
        raise IndexFormatError(f"{path}: not an index of this engine")
    if meta.get("version") != VERSION:
        raise IndexFormatError(f"{path}: the index has format {meta.get('version')}, this version reads {VERSION}; reset it and build anew")
    missing = [n for n in TABLES if not folder.exists(f"{meta['build']}/{n}")]
    if missing:
        raise IndexFormatError(f"{path}: the index lacks {', '.join(missing)}; reset it and build anew")
    index = Index(spark, folder.path, meta)
    if validate and (found := index.problems()):
        raise IndexFormatError(f"{path}: {'; '.join(found)}; reset it and build anew")
    return index


def reset_index(spark: SparkSession, path: str) -> None:
    SharedFolder(spark, path).remove()


def build_index(
    spark: SparkSession,
    path: str,
    listed: DataFrame,
    roots: DataFrame,
    contents: DataFrame | None = None,
    too_large: int = 0,
    before_commit: Callable[[], None] | None = None,
) -> Index:
    """Index the files of ``listed`` (root_ord, path) and make that the build that counts.

    ``contents`` (path, content) stands in for the file system. Files are numbered densely
    in the order of roots and path components, those skipped left out. Postings are lists,
    sorted by trigram and first file in ranges.
    """
    folder = SharedFolder(spark, path)
    build = f"v-{uuid.uuid4().hex}"
    at = f"{folder.path}/{build}"
    if contents is None:
        rows = read_contents(listed.select("root_ord", "path").repartition("path"))
    else:
        rows = listed.select("root_ord", "path").join(contents.select("path", "content"), "path", "left")
    keyed = rows.select(F.struct("root_ord", "path").alias("file"), "content")
    grams = materialize(analyzed(keyed, "file", "content").select("file.root_ord", "file.path", "reason", "n_bytes", "grams"), "analyzed")
    skips = grams.filter(F.col("reason").isNotNull()).select("root_ord", "path", "reason")
    good = grams.filter(F.col("reason").isNull()).select("root_ord", "path", "n_bytes", "grams")
    numbered = dense_ids(good, [F.col("root_ord"), F.split("path", "/")], "file_id")
    numbered.select("file_id", "root_ord", "path", "n_bytes").write.parquet(f"{at}/files")
    skips.write.parquet(f"{at}/skips")
    roots.select("root_ord", "path", "source").write.parquet(f"{at}/roots")
    lists = sorted_lists(numbered, "file_id")
    lists.write.options(**STORED).parquet(f"{at}/postings")
    written = {n: spark.read.schema(s).parquet(f"{at}/{n}") for n, s in TABLES.items() if n != "gram_counts"}
    gram_counts(written["postings"]).write.parquet(f"{at}/gram_counts")
    written["gram_counts"] = spark.read.schema(TABLES["gram_counts"]).parquet(f"{at}/gram_counts")
    counted = {n: df.count() for n, df in written.items()}
    n_bytes = written["files"].agg(F.sum("n_bytes")).first()[0] or 0
    entries = written["gram_counts"].agg(F.sum("n_files")).first()[0] or 0
    stats = Stats(counted["files"] + counted["skips"] + too_large, counted["files"], counted["skips"] + too_large, n_bytes, counted["gram_counts"], entries, folder.size(build))
    meta = {"family": FAMILY, "version": VERSION, "build": build, "rows": counted, "stats": stats.__dict__}
    if before_commit:
        before_commit()
    records = _records(folder)
    number = int(records[-1][8:-5]) + 1 if records else 1
    while not folder.create(f"current-{number:08d}.json", json.dumps(meta)):
        number += 1
    _drop_old(folder)
    return Index(spark, folder.path, meta)


def _drop_old(folder: SharedFolder) -> None:
    """Keep the last builds (a search may still read the one before); drop the others."""
    records = _records(folder)
    kept, gone = set(), []
    for name in records:
        try:
            build = json.loads(folder.read(name))["build"]
        except (ValueError, KeyError, TypeError):
            continue
        if name in records[-KEEP_BUILDS:]:
            kept.add(build)
        else:
            gone.append((name, build))
    for name, build in gone:
        folder.remove(name)
        if build not in kept:
            folder.remove(build)


def drop_abandoned(spark: SparkSession, path: str) -> None:
    """Remove the tables of builds that died before they counted. Only for a caller that
    holds the index's lock: another's build in progress looks the same."""
    folder = SharedFolder(spark, path)
    named = {json.loads(folder.read(n)).get("build") for n in _records(folder)}
    for name in folder.names():
        if name.startswith(("v-", ".draft-")) and name not in named:
            folder.remove(name)


__all__ = ["UNREADABLE", "Index", "IndexFormatError", "Stats", "build_index", "dense_ids", "drop_abandoned", "exists", "gram_counts", "lost_count", "open_index", "posting_blocks", "posting_rows", "read_contents", "reset_index", "sorted_lists"]
