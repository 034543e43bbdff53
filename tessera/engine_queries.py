"""Queries for the parts of the engine that deal with files, roots, stamps and printed
results: the rows of ``documents`` are written as files and listed, indexed and searched
where they lie; the other tables are put through the functions that a refresh uses."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.control import cli, compare, readonly, stamp
from tessera.functions import trigrams
from tessera.operators import grep, roots
from tessera.plans.analyze import regexp_query
from tessera.runtime import fresh_path, materialize, table
from tessera.search_queries import _OK, Query, _contents, _has, _lines_sql, _once, _store
from tessera.sources import index, listing, perforce

HIDDEN, BACKUP = "go", "css"
CALL = "return [A-Za-z_.]+\\("


def _in_python(df: DataFrame, schema: str, work) -> DataFrame:
    """``work``, from a row's values to a row's values or None, over all rows of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in batch.columns)) if (r := work(*x)) is not None]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = zip(*((n, kinds[t]) for n, t in (x.strip().split(" ") for x in schema.split(","))))
    return df.mapInArrow(run, schema)


# Files


def _tree(spark: SparkSession, d: str, without: str | None = None) -> tuple[str, DataFrame]:
    """Every text as a file below a folder of the shared file system, some with names that a
    listing passes over: the folder, and the paths by doc_id."""
    root = fresh_path(spark, "tree").removeprefix("file://")

    def put(doc_id: int, text: str, lang: str | None) -> tuple[int, str]:
        name = f"{'.' * (lang == HIDDEN)}{doc_id}.txt{'~' * (lang == BACKUP)}"
        folder = f"{root}/{doc_id // 100}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text.encode("utf-8"))
        return doc_id, f"{folder}/{name}"

    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    return root, materialize(_in_python(docs, "doc_id long, path string", put), "tree-files")


def _live(spark: SparkSession, d: str) -> tuple[str, listing.Snapshot, index.Index]:
    def make() -> tuple[str, listing.Snapshot, index.Index]:
        root, _ = _tree(spark, d)
        snap = listing.snapshot([listing.Root(root)])
        where = spark.createDataFrame([(0, root, "walk")], index.TABLES["roots"])
        return root, snap, index.build_index(spark, fresh_path(spark, "index"), snap.to_df(spark), where, too_large=snap.too_large)

    return _once(spark, d, "live", make)


def _name(root: str):
    return F.expr(f"substring(path, {len(root) + 2})").alias("name")


def walked_files(spark: SparkSession, d: str) -> DataFrame:
    """The listing of the written files: names that begin with a dot or end in ~ are out."""
    root, snap, _ = _live(spark, d)
    return snap.to_df(spark).select(_name(root), "len")


def live_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of hits, from the index over the files and their current bytes."""
    root, _, ix = _live(spark, d)
    return ix.search_counts(CALL).select(_name(root), "n")


def live_names(spark: SparkSession, d: str) -> DataFrame:
    root, _, ix = _live(spark, d)
    return ix.table("files").select("file_id", _name(root), "n_bytes")


def live_lost(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are gone by the time of the search: files are removed, once indexed."""
    root, paths = _tree(spark, d)
    snap = listing.snapshot([listing.Root(root)])
    ix = index.build_index(spark, fresh_path(spark, "index"), snap.to_df(spark), spark.createDataFrame([(0, root, "walk")], index.TABLES["roots"]))
    gone = paths.join(table(spark, d, "documents").filter("lang = 'python'").select("doc_id"), "doc_id", "left_semi").select("path")
    materialize(_in_python(gone, "n int", lambda path: (os.remove(path) or 1,)), "gone")
    return ix.lost_files(ix.found_files("return"))


def search_exit(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, code): what the command line's search ends with."""
    _, _, ix = _live(spark, d)
    rows = []
    for p in ("Copyright", "no such words at all"):
        args = SimpleNamespace(regexp=p, ignore_case=False, brute=False, file_regexp=None, verbose=False, list_files=True, count=False, no_names=False, line_numbers=False)
        rows.append((p, cli.search(ix, args, io.StringIO(), io.StringIO())))
    return spark.createDataFrame(rows, "pattern string, code int")


def index_replaced(spark: SparkSession, d: str) -> DataFrame:
    """(which, files): the build that counts after a second one, and the first one as a
    reader that opened it earlier still sees it."""
    docs = _contents(spark, d)
    at, where = fresh_path(spark, "index"), spark.createDataFrame([(0, "/docs", "walk")], index.TABLES["roots"])
    listed = docs.select(F.lit(0).alias("root_ord"), "path")
    long = docs.filter(F.length("content") > 1000).select("path")
    first = index.build_index(spark, at, listed.join(long, "path", "left_semi"), where, docs)
    index.build_index(spark, at, listed, where, docs)
    kept = lambda name, ix: ix.table("files").agg(F.count(F.lit(1)).alias("files")).select(F.lit(name).alias("which"), "files")
    return kept("first", first).unionByName(kept("counts", index.open_index(spark, at)))


# The stored index


def index_problems(spark: SparkSession, d: str) -> DataFrame:
    """What validation says of an index whose record tells of one file more than it has."""
    ix = _store(spark, d)
    damaged = index.Index(spark, ix.path, ix.meta | {"rows": ix.meta["rows"] | {"files": ix.num_files + 1}})
    return spark.createDataFrame([(p,) for p in damaged.problems() + ix.problems()], "problem string")


def index_roots(spark: SparkSession, d: str) -> DataFrame:
    docs = _contents(spark, d)
    where = table(spark, d, "roots").select("root_ord", "path", "source")
    return index.build_index(spark, fresh_path(spark, "index"), docs.select(F.lit(0).alias("root_ord"), "path"), where, docs).roots()


def index_names_of(spark: SparkSession, d: str) -> DataFrame:
    """Names of ids of every file, and of as many beyond them, which have none."""
    ix = _store(spark, d)
    return ix.names(spark.range(2 * ix.num_files).select(F.col("id").alias("file_id")))


def index_posting_counts(spark: SparkSession, d: str) -> DataFrame:
    ix = _store(spark, d)
    return spark.createDataFrame([(g, ix.posting_count(int.from_bytes(g.encode(), "big"))) for g in ("ret", "buc", "Cop", "@ge", "éx")], "gram string, n long")


def index_posting_query(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a query by the stored postings, by name."""
    ix = _store(spark, d)
    return ix.names(ix.posting_query(regexp_query("bucket engine"))).select("path")


def skip_invalid(spark: SparkSession, d: str) -> DataFrame:
    """The reasons against texts that end within a character."""
    cut = table(spark, d, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.lit(b"\xc3")).alias("content"))
    return trigrams.analyzed(cut, "doc_id", "content").select("doc_id", "reason")


# Printed results


def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).search_lines(CALL, contents=_contents(spark, d)).select(grep.rendered("lines", True, True).alias("printed"))


def printed_bare(spark: SparkSession, d: str) -> DataFrame:
    """Lines without names or numbers, each as often as it is found, with that number."""
    rows = _store(spark, d).search_lines(CALL, contents=_contents(spark, d)).select(grep.rendered("lines", False, False).alias("printed"))
    return rows.groupBy("printed").agg(F.count(F.lit(1)).alias("n"))


def printed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Printed counts, read back as a comparison of two tools reads them."""
    rows = _store(spark, d).search_counts(CALL, contents=_contents(spark, d)).select(grep.rendered("counts").alias("line"))
    return _in_python(rows, "path string, n long", lambda line: compare.count_line(line, "/docs"))


# Roots and stamps


def planned_roots(spark: SparkSession, d: str) -> DataFrame:
    """The roots of a next build: those without a source are removed, a folder of the first
    is named besides, which that one holds already. The roots of one index are few."""
    rows = table(spark, d, "roots").filter("path IS NOT NULL").select("path", "source").collect()
    stored = [listing.Root(r.path, r.source or "walk") for r in rows]
    plan = roots.plan_roots(stored, add=[f"{stored[0].path}/tools"] if stored else [], remove=[r.path for r in rows if r.source is None], is_dir=lambda p: True, real=lambda p: p, is_repository=lambda p: False)
    return spark.createDataFrame([(r.path, r.source) for r in plan.roots], "path string, source string")


def respelled_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths as a client spells them, below the folder ``src`` of a root that lies elsewhere."""
    rows = table(spark, d, "files").join(table(spark, d, "roots").select("root_ord", F.col("path").alias("root")), "root_ord").select("file_id", "path", "root")

    def work(file_id: int, path: str, root: str) -> tuple[int, str] | None:
        at = perforce.placed(path, root, f"/mnt{root}", f"/mnt{root}/src")
        return at and (file_id, at)

    return _in_python(rows, "file_id long, path string", work)


def stamp_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Stamps written out and parsed again; one that lacks anything gives none."""
    rows = table(spark, d, "stamps").select("stamp_id", "fingerprint", F.unix_micros(F.col("taken_at").cast("timestamp")).alias("us"), "index_bytes", "heads").filter("stamp_id IS NOT NULL").distinct()

    def work(stamp_id: int, mark: str | None, us: int | None, size: int | None, heads: str | None) -> tuple | None:
        lines = [stamp.HEADER, f"fingerprint {mark}" if mark else "", f"taken {us // 10**6} {us % 10**6 * 1000}" if us is not None else "", f"index {size}" if size is not None else "", f"head {heads}" if heads else ""]
        s = stamp.parse("\n".join(x for x in lines if x))
        again = s and stamp.parse(stamp.render(s))
        return again and (stamp_id, f"{again.fingerprint:016x}", again.taken_ns // 1000, again.index_bytes, " ".join(again.heads[0]) if again.heads else None)

    return _in_python(rows, "stamp_id long, fingerprint string, taken_us long, index_bytes long, head string", work)


COMMANDS = ["p4 sync", "p4 info", "p4 -c ws opened", "p4 -cws edit x", "p4 -V", "p4", "p4 --odd info", "git status", "p4 -p host:1 diff", "p4 submit", "p4 -s where", "p4 -Z info"]


def read_only_commands(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c, readonly.is_read_only(c.split()[0], c.split()[1:])) for c in COMMANDS], "command string, read_only boolean")


#: Expressions with the trigram query each is turned into.
EXPLAINED = {"Abcdef": "Abc bcd cde def", "abc.*(def|ghi)": "abc (def|ghi)", "a+hello": "ahe ell hel llo", "ab[cde]fgh": "fgh (abc bcf cfg)|(abd bdf dfg)|(abe bef efg)", "(abc){2,}": "abc bca cab", "(abc)?": "+", "abc?def": "def (abc bcd cde)|(abd bde)", r"\bfoobar\b": "bar foo oba oob", "x(abc|abd)y": "xab (abc|abd) (bcy|bdy)", "[a-z]+": "+"}


def explained(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p, str(regexp_query(p))) for p in EXPLAINED], "pattern string, query string")


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


_SHOWN = f"text IS NOT NULL AND coalesce(lang, '') NOT IN ('{HIDDEN}', '{BACKUP}')"
_FILE = "doc_id // 100 || '/' || doc_id || '.txt'"
_OK_SHOWN = _OK.replace("text IS NOT NULL", _SHOWN, 1)

ENGINE_QUERIES: dict[str, tuple[Query, str | None]] = {
    "walked_files": (walked_files, f"SELECT {_FILE} AS name, strlen(text) AS len FROM documents WHERE {_SHOWN}"),
    "live_counts": (live_counts, _lines_sql(CALL, "counts", where=_SHOWN).replace("SELECT doc_id, count(*)", f"SELECT {_FILE} AS name, count(*)")),
    "live_names": (live_names, f"WITH {_OK_SHOWN} SELECT row_number() OVER (ORDER BY CAST(doc_id // 100 AS VARCHAR), doc_id || '.txt') - 1 AS file_id, {_FILE} AS name, strlen(text) AS n_bytes FROM ok"),
    "live_lost": (live_lost, f"WITH {_OK_SHOWN} SELECT count(*) AS missing, CAST(0 AS BIGINT) AS unreadable FROM ok JOIN documents USING (doc_id) WHERE lang = 'python' AND {_has('return').replace('text', 'ok.text')}"),
    "search_exit": (search_exit, f"WITH {_OK_SHOWN} SELECT p AS pattern, CAST(CASE WHEN (SELECT count(*) FROM ok WHERE contains(text, p)) > 0 THEN {cli.MATCHED} ELSE {cli.NO_MATCH} END AS INTEGER) AS code FROM (VALUES ('Copyright'), ('no such words at all')) AS v(p)"),
    "index_replaced": (index_replaced, f"WITH {_OK} SELECT 'first' AS which, count(*) FILTER (WHERE length(text) > 1000) AS files FROM ok UNION ALL SELECT 'counts', count(*) FROM ok"),
    "index_problems": (index_problems, f"WITH {_OK} SELECT 'files has ' || count(*) || ' rows, not ' || (count(*) + 1) AS problem FROM ok"),
    "index_roots": (index_roots, "SELECT root_ord, path, source FROM roots"),
    "index_names_of": (index_names_of, f"""WITH {_OK}, named AS (SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS file_id, '/docs/' || doc_id AS path FROM ok)
SELECT file_id, path FROM named UNION ALL SELECT file_id + (SELECT count(*) FROM ok), '' FROM named"""),
    "index_posting_counts": (index_posting_counts, f"WITH {_OK} SELECT g AS gram, (SELECT count(*) FROM ok WHERE contains(text, g)) AS n FROM (VALUES ('ret'), ('buc'), ('Cop'), ('@ge'), ('éx')) AS v(g)"),
    "index_posting_query": (index_posting_query, f"WITH {_OK} SELECT '/docs/' || doc_id AS path FROM ok WHERE {_has('bucket engine')}"),
    "skip_invalid": (skip_invalid, "SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'invalid UTF-8' END AS reason FROM documents"),
    "printed_lines": (printed_lines, _lines_sql(CALL).replace("SELECT doc_id, line_no, line FROM", "SELECT '/docs/' || doc_id || ':' || line_no || ':' || line AS printed FROM")),
    "printed_bare": (printed_bare, _lines_sql(CALL).replace("SELECT doc_id, line_no, line FROM", "SELECT line AS printed, count(*) AS n FROM") + " GROUP BY line"),
    "printed_counts": (printed_counts, _lines_sql(CALL, "counts").replace("SELECT doc_id, count(*)", "SELECT CAST(doc_id AS VARCHAR) AS path, count(*)")),
    "planned_roots": (planned_roots, "SELECT path, source FROM roots WHERE path IS NOT NULL AND source IS NOT NULL"),
    "respelled_paths": (respelled_paths, "SELECT f.file_id, '/mnt' || f.path AS path FROM files f JOIN roots r USING (root_ord) WHERE starts_with(f.path, r.path || '/src/')"),
    "stamp_round_trip": (stamp_round_trip, """SELECT DISTINCT stamp_id, lower(fingerprint) AS fingerprint, epoch_us(taken_at) AS taken_us, index_bytes, heads AS head FROM stamps
  WHERE stamp_id IS NOT NULL AND regexp_full_match(fingerprint, '[0-9a-fA-F]{16}') AND taken_at IS NOT NULL AND index_bytes IS NOT NULL AND (heads IS NULL OR contains(heads, ' '))"""),
    "read_only_commands": (read_only_commands, _values([("p4 sync", False), ("p4 info", True), ("p4 -c ws opened", True), ("p4 -cws edit x", False), ("p4 -V", True), ("p4", True), ("p4 --odd info", False), ("git status", False), ("p4 -p host:1 diff", True), ("p4 submit", False), ("p4 -s where", True), ("p4 -Z info", False)], "command, read_only")),
    "explained": (explained, _values(list(EXPLAINED.items()), "pattern, query")),
}
