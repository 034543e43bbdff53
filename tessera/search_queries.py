"""Queries for indexing, candidate selection, searching, listing and refreshing, over the
test tables: the rows of ``documents`` are the files, by ``doc_id``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.control import compare, stamp
from tessera.functions import trigrams
from tessera.operators import grep, intervals, roots, snapdiff
from tessera.plans import hir
from tessera.plans.analyze import regexp_query
from tessera.plans.candidates import GramCounts, candidates, choose
from tessera.runtime import SharedFolder, fresh_path, materialize, spread, table
from tessera.sources import index, listing

Query = Callable[[SparkSession, str], DataFrame]
TEXTS_STORED = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "200"}
_KEPT: dict[tuple, object] = {}


def _as_of(spark: SparkSession, d: str) -> tuple:
    documents = f"{d}/documents.parquet"
    if "://" in d:
        return SharedFolder(spark, documents).changed()
    at = os.stat(documents)
    return at.st_mtime_ns, at.st_size, at.st_ino


def _once(spark: SparkSession, d: str, what: str, make: Callable[[], object]):
    """Tables that several queries start from are made once per application and input, and
    anew if the input was replaced."""
    key = (spark.sparkContext.applicationId, d, _as_of(spark, d), what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "path"))


def _grams(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "grams", lambda: materialize(trigrams.analyzed(_docs(spark, d), "doc_id", "text"), "doc-grams"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Lists (trigram, first, n, ids), sorted."""

    def make() -> DataFrame:
        lists = index.sorted_lists(_grams(spark, d).filter("reason IS NULL"), "doc_id", "doc-lists")
        return materialize(lists, "doc-postings", **index.STORED)

    return _once(spark, d, "postings", make)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "counts", lambda: materialize(index.gram_counts(_postings(spark, d)), "doc-counts"))


def _lookup(spark: SparkSession, d: str) -> GramCounts:
    return _once(spark, d, "lookup", lambda: GramCounts(_counts(spark, d)))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "indexed", lambda: materialize(_grams(spark, d).filter("reason IS NULL").select("doc_id"), "doc-indexed"))


def _n_indexed(spark: SparkSession, d: str) -> int:
    return _once(spark, d, "n-indexed", lambda: _indexed(spark, d).count())


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The indexed texts, sorted by doc_id in ranges and in small pages, so that a scan for
    a few of them passes over most."""

    def make() -> DataFrame:
        rows = table(spark, d, "documents").select("doc_id", "text", "path").join(_indexed(spark, d), "doc_id", "left_semi")
        return materialize(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "doc-texts", **TEXTS_STORED)

    return _once(spark, d, "texts", make)


def _store(spark: SparkSession, d: str) -> index.Index:
    def make() -> index.Index:
        docs = _contents(spark, d)
        where = spark.createDataFrame([(0, "/docs", "walk")], index.TABLES["roots"])
        return index.build_index(spark, fresh_path(spark, "index"), docs.select(F.lit(0).alias("root_ord"), "path"), where, docs)

    return _once(spark, d, "index", make)


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _found(spark: SparkSession, d: str, pattern: str, ignore_case: bool = False, name: str | None = None) -> DataFrame:
    """The texts that a search reads."""
    query = regexp_query(pattern, ignore_case)
    chosen = choose(_postings(spark, d), query, lambda: _indexed(spark, d), _lookup(spark, d), _n_indexed(spark, d), "doc_id")
    rows = chosen.of(_texts(spark, d), "doc_id")
    return grep.name_filter(rows, name) if name else rows


# SQL that the queries share

_OK = """ok AS (SELECT doc_id, text, path FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))
  AND coalesce(list_max(list_transform(string_split(text, chr(10)), lambda l: strlen(l))), 0) <= 2000)"""

_LINES = """lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, line, regexp_replace(line, '\\r$', '') AS bare FROM (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (
    SELECT doc_id, string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS parts FROM ok WHERE text <> '')))"""


def _lines_sql(pattern: str, mode: str = "lines", prefix: str = "", where: str = "true") -> str:
    ok = _OK if where == "true" else _OK.replace("IS NOT NULL", f"IS NOT NULL AND {where}", 1)
    hit = f"regexp_matches(bare, '{prefix}{pattern}')"
    tail = {
        "lines": f"SELECT doc_id, line_no, line FROM lines WHERE {hit}",
        "counts": f"SELECT doc_id, count(*) AS n FROM lines WHERE {hit} GROUP BY doc_id",
        "files": f"SELECT DISTINCT doc_id FROM lines WHERE {hit}",
        "totals": f"SELECT count(*) AS hits, count(DISTINCT doc_id) AS files FROM lines WHERE {hit}",
    }[mode]
    return f"WITH {ok}, {_LINES} {tail}"


def _has(text: str) -> str:
    return " AND ".join(f"contains(text, '{text[i : i + 3]}')" for i in range(len(text) - 2))


_GRAM_ROWS = f"""{_OK}, hexed AS (SELECT doc_id, hex(encode(text)) AS h FROM ok WHERE strlen(text) >= 3), pieces AS (
  SELECT doc_id, substr(h, 512 * k + 1, 516) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS k FROM hexed)), codes AS (
  SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(list_transform(range(0, least(256, length(h) // 2 - 2)), lambda i: substr(h, 2 * i + 1, 6))) AS t
    FROM pieces WHERE length(h) >= 6)), grams AS (SELECT doc_id, CAST('0x' || t AS INTEGER) AS trigram FROM codes)"""

_REASON = """SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN contains(text, chr(0)) THEN 'binary'
  WHEN list_max(list_transform(string_split(text, chr(10)), lambda l: strlen(l))) > 2000 THEN 'line too long' END AS reason FROM documents"""


# Indexing


def trigram_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _grams(spark, d).filter("reason IS NULL AND size(grams) > 0")
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("grams").cast("long").alias("n_trigrams"), total.alias("code_sum"))


def trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def trigram_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred trigrams held by most files: a report, hence the limit."""
    return _counts(spark, d).orderBy(F.desc("n_files"), "trigram").limit(100)


def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return index.posting_blocks(_postings(spark, d))


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reasons as the index gives them, the number of trigrams included; its SQL
    doesn't count trigrams."""
    return trigrams.analyzed(_docs(spark, d), "doc_id", "text").select("doc_id", "reason")


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    g = _grams(spark, d)
    ok = F.col("reason").isNull()
    seen = g.agg(F.count(F.lit(1)).alias("files_seen"), F.count_if(ok).alias("files_indexed"), F.count_if(~ok).alias("files_skipped"), F.sum(F.when(ok, F.col("n_bytes"))).alias("bytes_indexed"), F.sum(F.when(ok, F.size("grams"))).alias("posting_entries"))
    return seen.withColumn("distinct_trigrams", F.lit(_counts(spark, d).count()))


def file_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").select("root_ord", "path")
    return index.dense_ids(rows, [F.col("root_ord"), F.split("path", "/")], "dense_id")


def index_names(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).table("files").select("file_id", "path")


# Candidates


def _cand(pattern: str, ignore_case: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return candidates(_postings(spark, d), regexp_query(pattern, ignore_case), _indexed(spark, d), _lookup(spark, d), "doc_id")

    return run


def cand_none(spark: SparkSession, d: str) -> DataFrame:
    """An expression that nothing can match: how it is written, and its candidates."""
    never = "[^\\s\\S]abc"
    return _cand(never)(spark, d).agg(F.count(F.lit(1)).alias("candidates")).select(F.lit(str(regexp_query(never))).alias("query"), "candidates")


def posting_intersect(spark: SparkSession, d: str) -> DataFrame:
    p = index.posting_rows(_postings(spark, d), "doc_id")
    pick = lambda t: p.filter(F.col("trigram") == int.from_bytes(t, "big")).select("doc_id")
    return pick(b"buc").intersect(pick(b"eng"))


def posting_union(spark: SparkSession, d: str) -> DataFrame:
    p = index.posting_rows(_postings(spark, d), "doc_id")
    pick = lambda t: p.filter(F.col("trigram") == int.from_bytes(t, "big")).select("doc_id")
    return pick(b"0x7").union(pick(b"@ge")).distinct()


# Searching


def _lines(pattern: str, ignore_case: bool = False, name: str | None = None) -> Query:
    return lambda spark, d: grep.matching_lines(_found(spark, d, pattern, ignore_case, name), pattern, "doc_id", "text", ignore_case)


def _counted(pattern: str, ignore_case: bool = False) -> Query:
    return lambda spark, d: grep.match_counts(_found(spark, d, pattern, ignore_case), pattern, "doc_id", "text", ignore_case)


def search_files(spark: SparkSession, d: str) -> DataFrame:
    return grep.matching_files(_found(spark, d, "generated by [a-z]+"), "generated by [a-z]+", "doc_id", "text")


def search_brute(spark: SparkSession, d: str) -> DataFrame:
    return grep.match_counts(_texts(spark, d), "(reader|writer)[A-Z]", "doc_id", "text")


def search_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty hits in order, numbered: what a reader who stops early gets."""
    rows = grep.matching_lines(_found(spark, d, "assert"), "assert", "doc_id", "text").orderBy("doc_id", "line_no").limit(50)
    return rows.select("doc_id", "line_no", "line")


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    n = grep.match_counts(_found(spark, d, "Copyright"), "Copyright", "doc_id", "text")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits"), F.count(F.lit(1)).alias("files"))


def search_multiline(spark: SparkSession, d: str) -> DataFrame:
    """An expression over line ends: whole texts are searched; a hit counts once."""
    return grep.match_counts(_found(spark, d, r";\n[ \t]*\}"), r";\n[ \t]*\}", "doc_id", "text")


def search_index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Through a stored index, from its files and postings to the lines."""
    return _store(spark, d).search_counts("return [A-Za-z_.]+\\(", contents=_contents(spark, d)).select("path", "n")


def explain_search(spark: SparkSession, d: str) -> DataFrame:
    query = regexp_query("Copyright")
    found = candidates(_postings(spark, d), query, _indexed(spark, d), _lookup(spark, d), "doc_id")
    return found.agg(F.count(F.lit(1)).alias("candidates")).select(F.lit(str(query)).alias("query"), "candidates", F.lit(_n_indexed(spark, d)).alias("files"))


def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a search over everything reads: (doc_id, n_bytes) of the stored texts."""
    return _texts(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


#: Words that few texts hold.
RARE_PATTERNS = ["evict_packet", "write_vertex\\b", "dense_(budget|option)", "hopper(Unit|Orchard)", "node_schema|nodeWriter"]
PATTERNS = ["return", "TODO|FIXME", "foo.*bar", "hello", "[Bb]ucket.*[Ee]ngine", "^import ", "fn [a-z_]+\\(", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "unsafe impl Send", "(?i)license", "(?i)deprecated"]


def superset_check(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, matching, lost): how many files match, and how many of these are no
    candidates. There must be none of the latter."""
    rows = _texts(spark, d)
    out = None
    for p in PATTERNS:
        hit = grep.matching_files(rows, p, "doc_id", "text")
        both = hit.join(_cand(p)(spark, d).select("doc_id", F.lit(1).alias("_c")), "doc_id", "left")
        row = both.agg(F.count(F.lit(1)).alias("matching"), F.count_if(F.col("_c").isNull()).alias("lost")).select(F.lit(p).alias("pattern"), "matching", "lost")
        out = row if out is None else out.unionByName(row)
    return out


def parity_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts through the index against counts without it, of two expressions of which one
    finds more: where they differ, and how."""
    a = _counted("return")(spark, d)
    rows = compare.differences(a, grep.match_counts(_texts(spark, d), "return [A-Za-z_.]+\\(", "doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("left_n").alias("indexed"), F.col("right_n").alias("brute"), "kind")


def parity_kept(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, files, differing): files with a hit without the index, and those whose
    count differs through it. There must be none of the latter."""
    out = None
    for p in ("(reader|writer)[A-Z]", "assert", "fn [a-z_]+\\("):
        without = grep.match_counts(_texts(spark, d), p, "doc_id", "text")
        n = compare.differences(_counted(p)(spark, d), without, "doc_id").agg(F.count(F.lit(1)).alias("differing"))
        row = without.agg(F.count(F.lit(1)).alias("files")).crossJoin(n).select(F.lit(p).alias("pattern"), "files", "differing")
        out = row if out is None else out.unionByName(row)
    return out


#: Expressions with what their candidates hold.
SHARED = {
    "return": _has("return"),
    "TODO|FIXME": f"({_has('TODO')}) OR ({_has('FIXME')})",
    "hello": _has("hello"),
    "[Bb]ucket.*[Ee]ngine": f"{_has('ucket')} AND {_has('ngine')} AND (contains(text, 'Buc') OR contains(text, 'buc')) AND (contains(text, 'Eng') OR contains(text, 'eng'))",
    "^import ": _has("import "),
    "fn [a-z_]+\\(": _has("fn "),
    "unsafe impl Send": _has("unsafe impl Send"),
}


def candidate_share(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, candidates): how much of the corpus each pattern leaves to be read."""
    out = None
    for p in SHARED:
        row = _cand(p)(spark, d).agg(F.count(F.lit(1)).alias("candidates")).select(F.lit(p).alias("pattern"), "candidates")
        out = row if out is None else out.unionByName(row)
    return out


# Listing and refreshing


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by the rules of a listing: no skipped component below the root."""
    rows = table(spark, d, "files").join(table(spark, d, "roots").select("root_ord", F.col("path").alias("_root")), "root_ord")
    below = F.expr("substring(path, length(_root) + 2)")
    return rows.filter(roots.within(F.col("path"), F.col("_root")) & ~listing.skipped_path(below)).select("file_id", "path")


def collapsed_roots(spark: SparkSession, d: str) -> DataFrame:
    """The roots with every folder just below them that holds files, as if all were roots."""
    own = table(spark, d, "roots").select("path", "source")
    sub = table(spark, d, "files").select(F.array_join(F.slice(F.split("path", "/"), 1, 5), "/").alias("path"), F.lit(None).cast("string").alias("source")).distinct()
    return roots.collapse(own.unionByName(sub)).select("path", "covered_by")


def coarse_mtime(spark: SparkSession, d: str) -> DataFrame:
    return listing.coarse_mtimes(table(spark, d, "file_entries").filter("snap_id IS NOT NULL"), "snap_id")


def listing_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """(snap_id, files, alike): the least snapshot of the same root whose listing has the
    same fingerprint, which is a listing equal to this one. Empty listings have no row."""
    sequence = materialize(intervals.in_sequence(table(spark, d, "snapshots")), "sequence")
    rows = snapdiff.latest_listings(snapdiff.readings(table(spark, d, "file_entries"), sequence)).select("root_ord", "snap_id", "path", "len", F.col("mtime.mtime_s").alias("mtime_s"), F.col("mtime.mtime_ns").alias("mtime_ns"))
    marks = listing.listing_fingerprints(rows, "snap_id").join(sequence.select("snap_id", "root_ord"), "snap_id")
    same = marks.groupBy("root_ord", "fingerprint").agg(F.min("snap_id").alias("alike"))
    return marks.join(same, ["root_ord", "fingerprint"]).select("snap_id", "files", "alike")


def refresh_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return stamp.verdicts(table(spark, d, "snapshots"), table(spark, d, "stamps"), coarse_mtime(spark, d))


def heads_moved(spark: SparkSession, d: str) -> DataFrame:
    """Stamps whose head is not the one last written for the root."""
    stamps = table(spark, d, "stamps").filter("stamp_id IS NOT NULL").dropDuplicates(["stamp_id"])
    told = stamps.filter("heads IS NOT NULL").select("stamp_id", "written_at", F.substring_index("heads", " ", 1).alias("head"), F.expr("substring(heads, instr(heads, ' ') + 1)").alias("root"))
    current = told.groupBy("root").agg(F.max_by("head", F.struct("written_at", "stamp_id")).alias("now"))
    return stamp.moved_heads(stamps, current)


LISTED_ALIKE = """WITH rows AS (SELECT n.root_ord, e.snap_id, '/' || array_to_string(list_reduce(
    list_transform(string_split(nfc_normalize(e.path), '/'), lambda p: [p]),
    lambda kept, p: CASE WHEN p[1] IN ('', '.') THEN kept WHEN p[1] = '..' THEN kept[:-2] ELSE list_concat(kept, p) END,
    CAST([] AS VARCHAR[])), '/') AS path, e.len, e.mtime_s, e.mtime_ns, e.seen_at FROM file_entries e JOIN snapshots n USING (snap_id) WHERE e.path IS NOT NULL), cur AS (
  SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY snap_id, path ORDER BY seen_at DESC NULLS LAST, len DESC NULLS LAST, mtime_s DESC NULLS LAST, mtime_ns DESC NULLS LAST) = 1), lists AS (
  SELECT root_ord, snap_id, count(*) AS files, list((path, len, mtime_s, mtime_ns) ORDER BY path) AS held FROM cur GROUP BY ALL)
SELECT snap_id, files, min(snap_id) OVER (PARTITION BY root_ord, held) AS alike FROM lists"""

SEARCH_QUERIES: dict[str, tuple[Query, str | None]] = {
    "trigram_extract": (trigram_extract, f"WITH {_GRAM_ROWS} SELECT doc_id, count(*) AS n_trigrams, CAST(sum(trigram) AS BIGINT) AS code_sum FROM grams GROUP BY doc_id"),
    "trigram_counts": (trigram_counts, f"WITH {_GRAM_ROWS} SELECT trigram, count(*) AS n_files FROM grams GROUP BY trigram"),
    "trigram_top": (trigram_top, f"WITH {_GRAM_ROWS} SELECT trigram, count(*) AS n_files FROM grams GROUP BY trigram ORDER BY n_files DESC, trigram LIMIT 100"),
    "posting_lists": (posting_lists, f"WITH {_GRAM_ROWS} SELECT trigram, doc_id // 1048576 AS block, count(*) AS cnt, min(doc_id) AS first_id, max(doc_id) AS last_id FROM grams GROUP BY ALL"),
    "skip_reasons": (skip_reasons, _REASON),
    "index_stats": (index_stats, f"""WITH {_GRAM_ROWS} SELECT (SELECT count(*) FROM documents) AS files_seen, (SELECT count(*) FROM ok) AS files_indexed,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM ok) AS files_skipped, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM ok) AS bytes_indexed,
  count(*) AS posting_entries, count(DISTINCT trigram) AS distinct_trigrams FROM grams"""),
    "file_ids": (file_ids, "SELECT root_ord, path, row_number() OVER (ORDER BY root_ord, string_split(path, '/')) - 1 AS dense_id FROM files"),
    "index_names": (index_names, f"WITH {_OK} SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS file_id, '/docs/' || doc_id AS path FROM ok"),
    "cand_and": (_cand("bucket engine"), f"WITH {_OK} SELECT doc_id FROM ok WHERE {_has('bucket engine')}"),
    "cand_or": (_cand("Copyright|@generated"), f"WITH {_OK} SELECT doc_id FROM ok WHERE ({_has('Copyright')}) OR ({_has('@generated')})"),
    "cand_nested": (_cand("assert.*(bucket|engine)"), f"WITH {_OK} SELECT doc_id FROM ok WHERE {_has('assert')} AND (({_has('bucket')}) OR ({_has('engine')}))"),
    "cand_class": (_cand("ab[cde]"), f"WITH {_OK} SELECT doc_id FROM ok WHERE contains(text, 'abc') OR contains(text, 'abd') OR contains(text, 'abe')"),
    "cand_all": (_cand("[a-z]+"), f"WITH {_OK} SELECT doc_id FROM ok"),
    "cand_none": (cand_none, "SELECT '-' AS query, CAST(0 AS BIGINT) AS candidates"),
    "cand_repeat": (_cand("(er|ti){2}"), f"WITH {_OK} SELECT doc_id FROM ok WHERE " + " OR ".join(f"({_has(x)})" for x in ("erer", "erti", "tier", "titi"))),
    "cand_counted": (_cand("(ret){1,3}urn"), f"WITH {_OK} SELECT doc_id FROM ok WHERE contains(text, 'ret') AND contains(text, 'urn')"),
    "cand_icase": (_cand("abc", True), f"WITH {_OK} SELECT doc_id FROM ok WHERE regexp_matches(text, '(?i)abc')"),
    "posting_intersect": (posting_intersect, f"WITH {_OK} SELECT doc_id FROM ok WHERE contains(text, 'buc') INTERSECT SELECT doc_id FROM ok WHERE contains(text, 'eng')"),
    "posting_union": (posting_union, f"WITH {_OK} SELECT doc_id FROM ok WHERE contains(text, '0x7') UNION SELECT doc_id FROM ok WHERE contains(text, '@ge')"),
    "search_lines": (_lines("return [A-Za-z_.]+\\("), _lines_sql("return [A-Za-z_.]+\\(")),
    "search_counts": (_counted("(reader|writer)[A-Z]"), _lines_sql("(reader|writer)[A-Z]", "counts")),
    "search_texts": (search_texts, f"WITH {_OK} SELECT doc_id, strlen(text) AS n_bytes FROM ok"),
    "search_files": (search_files, _lines_sql("generated by [a-z]+", "files")),
    "search_icase": (_lines("copyright \\(c\\)", True), _lines_sql("copyright \\(c\\)", prefix="(?i)")),
    "search_name_filter": (_lines("import", name="\\.(rs|go)$"), _lines_sql("import", where="regexp_matches(path, '\\.(rs|go)$')")),
    "search_brute": (search_brute, _lines_sql("(reader|writer)[A-Z]", "counts")),
    "search_anchors": (_counted("^import .*;$"), _lines_sql("^import [^\\r]*;$", "counts")),
    "search_empty_lines": (_counted("^$"), _lines_sql("^$", "counts")),
    "search_ordered": (search_ordered, _lines_sql("assert") + " ORDER BY doc_id, line_no LIMIT 50"),
    "search_totals": (search_totals, _lines_sql("Copyright", "totals")),
    "search_multiline": (search_multiline, f"WITH {_OK} SELECT doc_id, n FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, ';\\n[ \\t]*\\}}[^\\n]*')) AS BIGINT) AS n FROM ok) WHERE n > 0"),
    "search_index_counts": (search_index_counts, _lines_sql("return [A-Za-z_.]+\\(", "counts").replace("SELECT doc_id, count(*)", "SELECT '/docs/' || doc_id AS path, count(*)")),
    "explain_search": (explain_search, f"WITH {_OK} SELECT 'Cop ght igh opy pyr rig yri' AS query, count(*) FILTER (WHERE {_has('Copyright')}) AS candidates, count(*) AS files FROM ok"),
    "candidate_share": (candidate_share, f"WITH {_OK} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS candidates FROM ok WHERE {test}" for p, test in SHARED.items())),
    "superset_check": (superset_check, f"WITH {_OK}, {_LINES} SELECT p AS pattern, (SELECT count(DISTINCT doc_id) FROM lines WHERE regexp_matches(bare, p)) AS matching, CAST(0 AS BIGINT) AS lost FROM (VALUES {', '.join(f"('{p}')" for p in PATTERNS)}) AS v(p)"),
    "parity_diff": (parity_diff, f"""WITH {_OK}, {_LINES}, a AS (SELECT doc_id, count(*) AS indexed FROM lines WHERE regexp_matches(bare, 'return') GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS brute FROM lines WHERE regexp_matches(bare, 'return [A-Za-z_.]+\\(') GROUP BY doc_id)
SELECT doc_id, indexed, brute, CASE WHEN brute IS NULL THEN 'only left' WHEN indexed IS NULL THEN 'only right' ELSE 'count' END AS kind FROM a FULL JOIN b USING (doc_id) WHERE indexed IS DISTINCT FROM brute"""),
    "parity_kept": (parity_kept, f"WITH {_OK}, {_LINES} SELECT p AS pattern, (SELECT count(DISTINCT doc_id) FROM lines WHERE regexp_matches(bare, p)) AS files, CAST(0 AS BIGINT) AS differing FROM (VALUES ('(reader|writer)[A-Z]'), ('assert'), ('fn [a-z_]+\\(')) AS v(p)"),
    "listed_files": (listed_files, """SELECT f.file_id, f.path FROM files f JOIN roots r USING (root_ord) WHERE starts_with(f.path, r.path || '/')
  AND NOT regexp_matches(substr(f.path, length(r.path) + 2), '(^|/)[.#~]|~(/|$)')"""),
    "collapsed_roots": (collapsed_roots, """WITH every AS (SELECT path FROM roots WHERE path IS NOT NULL UNION SELECT array_to_string(string_split(path, '/')[1:5], '/') FROM files)
SELECT e.path, (SELECT min_by(o.path, length(o.path)) FROM every o WHERE o.path <> e.path AND starts_with(e.path, o.path || '/')) AS covered_by FROM every e"""),
    "coarse_mtime": (coarse_mtime, """SELECT snap_id, CASE WHEN bool_and(mtime_s IS NOT NULL AND mtime_s >= 0 AND coalesce(mtime_ns, 0) = 0) THEN max(mtime_s) END AS newest
FROM file_entries WHERE snap_id IS NOT NULL GROUP BY snap_id"""),
    "listing_fingerprint": (listing_fingerprint, LISTED_ALIKE),
    "refresh_verdicts": (refresh_verdicts, """WITH coarse AS (SELECT snap_id, CASE WHEN bool_and(mtime_s IS NOT NULL AND mtime_s >= 0 AND coalesce(mtime_ns, 0) = 0) THEN max(mtime_s) END AS newest
  FROM file_entries GROUP BY snap_id), good AS (SELECT * FROM stamps WHERE fingerprint IS NOT NULL AND root_ord IS NOT NULL AND taken_at IS NOT NULL AND written_at IS NOT NULL), last AS (
  SELECT n.snap_id, n.fingerprint, s.fingerprint AS mark, s.taken_at AS taken FROM snapshots n LEFT JOIN good s ON s.root_ord = n.root_ord AND s.written_at <= n.taken_at
  QUALIFY row_number() OVER (PARTITION BY n.snap_id ORDER BY s.written_at DESC NULLS LAST, s.stamp_id DESC) = 1)
SELECT snap_id, CASE WHEN mark IS NULL THEN 'no stamp' WHEN lower(fingerprint) IS DISTINCT FROM lower(mark) THEN 'changed'
  WHEN newest * 1000000 + 2000000 > epoch_us(taken) THEN 'too close' ELSE 'current' END AS verdict FROM last LEFT JOIN coarse USING (snap_id)"""),
    "heads_moved": (heads_moved, """WITH told AS (SELECT DISTINCT stamp_id, written_at, split_part(heads, ' ', 1) AS head, substr(heads, instr(heads, ' ') + 1) AS root FROM stamps
  WHERE heads IS NOT NULL AND stamp_id IS NOT NULL), cur AS (SELECT root, max_by(head, (written_at, stamp_id)) AS now FROM told GROUP BY root)
SELECT stamp_id, root, head, now FROM told JOIN cur USING (root) WHERE now <> head"""),
}
