"""The catalogue of queries: name -> (Spark query, SQL with the same result or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine_queries import ENGINE_QUERIES
from tessera.operators import intervals, radix, skew, snapdiff
from tessera.runtime import fresh_path, table
from tessera.search_queries import SEARCH_QUERIES

Query = Callable[[SparkSession, str], DataFrame]

_POSTINGS = """valid AS (
  SELECT DISTINCT trigram, file_id, block, cnt, build_id FROM postings
  WHERE trigram IS NOT NULL AND file_id IN (SELECT file_id FROM files)), stats AS (
  SELECT trigram, count(*) AS n_rows, count(DISTINCT file_id) AS n_files,
         CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS sum_cnt FROM valid GROUP BY trigram)"""

_RESOLVE = """'/' || array_to_string(list_reduce(
    list_transform(string_split(nfc_normalize(path), '/'), lambda p: [p]),
    lambda kept, p: CASE WHEN p[1] IN ('', '.') THEN kept WHEN p[1] = '..' THEN kept[:-2] ELSE list_concat(kept, p) END,
    CAST([] AS VARCHAR[])), '/')"""


def _listing(ordinals: str) -> str:
    """CTEs ``seq`` (given) and ``cur``: one row per file and snapshot."""
    return f"""{ordinals}, readings AS (
  SELECT s.root_ord, s.seq, s.snap_id, {_RESOLVE} AS path, len, mtime_s, mtime_ns, seen_at
  FROM file_entries JOIN seq s USING (snap_id) WHERE path IS NOT NULL), cur AS (
  SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY snap_id, path
    ORDER BY seen_at DESC NULLS LAST, len DESC NULLS LAST, mtime_s DESC NULLS LAST, mtime_ns DESC NULLS LAST) = 1), pairs AS (
  SELECT b.snap_id, b.root_ord, a.snap_id AS base FROM seq a JOIN seq b ON a.root_ord = b.root_ord AND b.seq = a.seq + 1)"""


_EVERY = """seq AS (
  SELECT snap_id, root_ord, row_number() OVER (PARTITION BY root_ord ORDER BY taken_at NULLS FIRST, snap_id) AS seq FROM snapshots)"""

_INDEXED = """seq AS (
  SELECT snap_id, root_ord, row_number() OVER (PARTITION BY root_ord ORDER BY taken_at NULLS FIRST, snap_id) AS seq FROM snapshots n
  WHERE EXISTS (SELECT 1 FROM stamps s WHERE s.snap_id = n.snap_id AND lower(s.fingerprint) = lower(n.fingerprint)))"""

_DIFFERS = "(a.len IS DISTINCT FROM b.len OR a.mtime_s IS DISTINCT FROM b.mtime_s OR a.mtime_ns IS DISTINCT FROM b.mtime_ns)"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_trigrams(table(spark, d, "postings"), table(spark, d, "files"))


def p1_trigram_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.trigram_stats(table(spark, d, "postings"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapdiff.refresh_rows(table(spark, d, "file_entries"), table(spark, d, "snapshots"), table(spark, d, "stamps"))


def p2_after_failure(spark: SparkSession, d: str) -> DataFrame:
    """``p2_found`` in three runs over one ledger: the stamps of the first half of the time;
    all stamps, but the run dies before it commits; all stamps again."""
    entries, snapshots, stamps = (table(spark, d, t) for t in ("file_entries", "snapshots", "stamps"))
    ledger = intervals.Ledger(spark, fresh_path(spark, "refresh"))
    half = stamps.agg(((F.min("written_at").cast("timestamp").cast("double") + F.max("written_at").cast("timestamp").cast("double")) / 2).alias("t")).first().t
    snapdiff.refresh_new(ledger, entries, snapshots, stamps.filter(F.col("written_at").cast("timestamp").cast("double") <= F.lit(half)))

    class Dies(intervals.Ledger):
        def commit(self, *_: object) -> intervals.Commit:
            raise InterruptedError

    try:
        snapdiff.refresh_new(Dies(spark, ledger.path), entries, snapshots, stamps)
    except InterruptedError:
        pass
    snapdiff.refresh_new(ledger, entries, snapshots, stamps)
    return snapdiff.refreshed(ledger, entries)


def p2_processed(spark: SparkSession, d: str) -> DataFrame:
    snapshots, stamps = table(spark, d, "snapshots"), table(spark, d, "stamps")
    done = intervals.in_sequence(snapshots).join(intervals.indexed_snapshots(snapshots, stamps).select("snap_id"), "snap_id", "left_semi")
    return intervals.islands(done, "root_ord", "seq")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapdiff.snapshot_changes(table(spark, d, "file_entries"), table(spark, d, "snapshots"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = radix.marked_frequencies(table(spark, d, "postings"), table(spark, d, "files"))
    return rows.select("trigram", "mark").filter("mark IS NOT NULL")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return radix.marked_frequencies(table(spark, d, "postings"), table(spark, d, "files"))


def p5_small_leaves(spark: SparkSession, d: str) -> DataFrame:
    """``p5_frequencies`` with leaves so small that buckets are split over several levels,
    and the heaviest terms by record, at every size of the tables."""
    return radix.marked_frequencies(table(spark, d, "postings"), table(spark, d, "files"), leaf_rows=500)


def p5_build_claims(spark: SparkSession, d: str) -> DataFrame:
    return radix.build_claims(table(spark, d, "postings"), table(spark, d, "files"), table(spark, d, "build_stats"))


_MARKED = f"""WITH {_POSTINGS}, marked AS (SELECT *, CASE WHEN n_files <= 2 THEN 'rare'
  WHEN n_files * 5 > (SELECT count(DISTINCT file_id) FROM valid) THEN 'common' END AS mark FROM stats)"""

_P2 = f"""WITH {_listing(_INDEXED)}
SELECT p.snap_id, b.path FROM pairs p JOIN cur b ON b.snap_id = p.snap_id
LEFT JOIN cur a ON a.snap_id = p.base AND a.path = b.path WHERE a.snap_id IS NULL OR {_DIFFERS}"""

DATA_QUERIES: dict[str, tuple[Query, str | None]] = {
    "p1_found": (p1_found, f"WITH {_POSTINGS} SELECT trigram FROM stats WHERE n_rows * 100 > 2 * (SELECT count(*) FROM valid)"),
    "p1_trigram_stats": (p1_trigram_stats, f"WITH {_POSTINGS} SELECT * FROM stats"),
    "p2_found": (p2_found, _P2),
    "p2_after_failure": (p2_after_failure, _P2),
    "p2_processed": (p2_processed, """WITH every AS (SELECT snap_id, root_ord, fingerprint,
  row_number() OVER (PARTITION BY root_ord ORDER BY taken_at NULLS FIRST, snap_id) AS seq FROM snapshots), done AS (
  SELECT root_ord, seq FROM every n WHERE EXISTS (SELECT 1 FROM stamps s WHERE s.snap_id = n.snap_id AND lower(s.fingerprint) = lower(n.fingerprint))),
  k AS (SELECT *, seq - row_number() OVER (PARTITION BY root_ord ORDER BY seq) AS k FROM done)
SELECT root_ord, CAST(min(seq) AS INTEGER) AS lo, CAST(max(seq) AS INTEGER) AS hi FROM k GROUP BY root_ord, k"""),
    "p3_found": (p3_found, f"""WITH {_listing(_EVERY)}, later AS (SELECT p.snap_id AS target, c.* FROM pairs p JOIN cur c ON c.snap_id = p.snap_id),
earlier AS (SELECT p.snap_id AS target, c.* FROM pairs p JOIN cur c ON c.snap_id = p.base)
SELECT coalesce(b.target, a.target) AS snap_id, coalesce(b.path, a.path) AS path,
  CASE WHEN a.target IS NULL THEN 'added' WHEN b.target IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM later b FULL JOIN earlier a ON a.target = b.target AND a.path = b.path
WHERE a.target IS NULL OR b.target IS NULL OR {_DIFFERS}"""),
    "p5_found": (p5_found, f"{_MARKED} SELECT trigram, mark FROM marked WHERE mark IS NOT NULL"),
    "p5_frequencies": (p5_frequencies, f"{_MARKED} SELECT * FROM marked"),
    "p5_small_leaves": (p5_small_leaves, f"{_MARKED} SELECT * FROM marked"),
    "p5_build_claims": (p5_build_claims, """WITH valid AS (SELECT DISTINCT trigram, file_id, block, cnt, build_id FROM postings
  WHERE trigram IS NOT NULL AND file_id IN (SELECT file_id FROM files)), held AS (
  SELECT build_id, count(DISTINCT trigram) AS t, count(*) AS e FROM valid GROUP BY build_id)
SELECT b.build_id, b.distinct_trigrams AS claimed_trigrams, b.posting_entries AS claimed_entries,
  coalesce(t, 0) AS held_trigrams, coalesce(e, 0) AS held_entries FROM build_stats b LEFT JOIN held USING (build_id)"""),
}


def catalogue() -> dict[str, tuple[Query, str | None]]:
    return DATA_QUERIES | SEARCH_QUERIES | ENGINE_QUERIES
