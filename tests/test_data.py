"""Salted aggregation, interval ledger, snapshot merge, radix frequencies."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.paths import resolve, resolved
from tessera.operators import intervals, radix, skew, snapdiff
from tessera.runtime import fresh_path

POSTING = "trigram int, file_id long, block int, cnt int, build_id long, note string"


def brute_stats(rows, files):
    valid = {r[:5] for r in rows if r[0] is not None and r[1] in files}
    return {t: (sum(1 for r in valid if r[0] == t), len({r[1] for r in valid if r[0] == t}), sum(r[3] or 0 for r in valid if r[0] == t)) for t in {r[0] for r in valid}}


@pytest.fixture(scope="module")
def postings(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1] * 6 + [2, 2, 3, 4, 5, None]), rng.choice([*range(40), 99, None]), rng.randint(0, 2), rng.choice([None, 1, 2, 3]), rng.randint(1, 2), "x") for _ in range(1500)]
    rows += rows[:200] + [(7, 1, 0, None, 1, "x")] * 300 + [(8, 99, 0, 1, 1, "x")]
    files = set(range(40))
    return spark.createDataFrame(rows, POSTING), spark.createDataFrame([(f,) for f in [*files, 5, None]], "file_id long"), brute_stats(rows, files)


def stats_of(df):
    return {r.trigram: (r.n_rows, r.n_files, r.sum_cnt) for r in df.collect()}


def test_salted_statistics(spark, postings):
    df, files, want = postings
    assert stats_of(skew.trigram_stats(df, files)) == want
    assert stats_of(skew.trigram_stats(df, files, share=0.1, salts=3)) == want
    assert stats_of(skew.trigram_stats(df.filter("false"), files)) == {} == stats_of(skew.trigram_stats(df, files.filter("false")))
    total = sum(v[0] for v in want.values())
    assert {r.trigram for r in skew.dominant_trigrams(df, files, 20).collect()} == {t for t, v in want.items() if v[0] > total * 0.2}


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame([(None,)] * 50 + [(1,)] * 30 + [(i,) for i in range(100, 120)], "k int")
    assert {r.k for r in skew.heavy_keys(df, "k", 0.2).collect()} == {None, 1}
    assert skew.heavy_keys(df.filter("false"), "k", 0.2).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, "k", 0)


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [(1, 1), (1, None)], "k int, v int")
    got = skew.salted_aggregate(df, "k", ["v"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, share=0.2, salts=4)
    assert {(r.k, r.n, r.s) for r in got.collect()} == {(None, 40, 780), (1, 2, 1)}


def test_salts_only_on_heavy_keys(spark):
    df = spark.createDataFrame([(1, i) for i in range(90)] + [(2, i) for i in range(10)], "k int, v int")
    salts = {k: {r._salt for r in skew.salted(df, "k", ["v"], 0.5, 8).filter(F.col("k") == k).collect()} for k in (1, 2)}
    assert len(salts[1]) > 4 and salts[2] == {0}


@pytest.mark.parametrize("leaf_rows", [3, 50, 10**6])
def test_radix_frequencies(spark, postings, leaf_rows):
    df, files, want = postings
    assert stats_of(radix.term_frequencies(df, files, leaf_rows)) == want


def test_marks(spark, postings):
    df, files, want = postings
    held = len({r.file_id for r in df.filter("trigram IS NOT NULL").select("file_id").distinct().collect()} & set(range(40)))
    marks = {r.trigram: r.mark for r in radix.marked_frequencies(df, files, leaf_rows=20).collect()}
    assert marks == {t: "rare" if v[1] <= 2 else "common" if v[1] * 5 > held else None for t, v in want.items()}
    assert radix.marked_frequencies(df.filter("false"), files).count() == 0


def test_radix_splits_a_single_hot_term(spark):
    rows = spark.createDataFrame([(5, i) for i in range(200)] + [(6, 1)], "term long, file_id long").withColumn("n_rows", F.lit(1)).withColumn("sum_cnt", F.lit(1))
    leaves = radix.radix_leaves(rows, "term", "file_id", 20)
    assert leaves.filter("term = 5").select("_leaf").distinct().count() > 5 and leaves.count() == 201
    assert leaves.groupBy("_leaf").count().agg(F.max("count")).first()[0] < 60


def test_build_claims(spark, postings):
    df, files, _ = postings
    stats = spark.createDataFrame([(1, 5, 9), (2, None, 1), (3, 4, 4)], "build_id long, distinct_trigrams long, posting_entries long")
    got = {r.build_id: (r.claimed_trigrams, r.claimed_entries, r.held_trigrams) for r in radix.build_claims(df, files, stats).collect()}
    assert got[3] == (4, 4, 0) and got[2][0] is None and got[1][2] > 3


# Intervals

spans = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)


def covered(parts):
    return {i for lo, hi in parts for i in range(lo, hi + 1)}


@given(spans, spans)
def test_interval_algebra(a, b):
    m = intervals.merged(a)
    assert covered(m) == covered(a) and all(x[1] + 1 < y[0] for x, y in zip(m, m[1:]))
    assert covered(intervals.gaps(a, b)) == covered(a) - covered(b)


def test_only_new_records_are_processed(spark):
    ledger = intervals.Ledger(spark, fresh_path(spark, "ledger"))
    rows = lambda xs: spark.createDataFrame([(x, f"v{x}") for x in xs], "seq long, v string")
    seen = []

    def work(df):
        seen.append(sorted(r.seq for r in df.collect()))
        return df

    assert ledger.output() is None
    assert intervals.process_new(ledger, rows([1, 2, 3, 7]), "seq", work) == [(1, 3), (7, 7)]
    assert intervals.process_new(ledger, rows([1, 2, 3, 7]), "seq", work) == []

    def fails(df):
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        intervals.process_new(ledger, rows(range(1, 10)), "seq", fails)
    assert intervals.process_new(ledger, rows([1, 2, 3, 4, 5, 7, 7, None, 9]), "seq", work) == [(4, 5), (9, 9)]  # 4 and 5 came late
    assert seen == [[1, 2, 3, 7], [4, 5, 9]] and ledger.read().done == ((1, 5), (7, 7), (9, 9))
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 2, 3, 4, 5, 7, 9]


def test_many_holes(spark):
    ledger = intervals.Ledger(spark, fresh_path(spark, "ledger"))
    keep = lambda df: df.select("id")
    odd = spark.range(1, 200_001, 2)
    done = intervals.process_new(ledger, odd, "id", keep)
    assert len(done) == 100_000 and ledger.output().count() == 100_000
    assert intervals.process_new(ledger, spark.range(1, 200_011), "id", keep) == [(i, i) for i in range(2, 200_001, 2)][:-1] + [(200_000, 200_010)]
    assert ledger.read().done == ((1, 200_010),) and ledger.output().count() == 200_010 == ledger.output().distinct().count()
    assert intervals.process_new(ledger, odd, "id", keep) == []


def test_gaps_in_passes(spark):
    ledger = intervals.Ledger(spark, fresh_path(spark, "ledger"))
    ledger.WHOLE = 3
    numbers = [n for n in range(60) if n % 3] + [100, 101, 102]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    intervals.process_new(ledger, rows, "n", lambda df: df, most=4)
    got = ledger.read()
    assert sorted(r.n for r in ledger.output().collect()) == numbers and got.version > 3 and len(got.outputs) == got.version
    assert got.done == tuple(intervals.merged((n, n) for n in numbers))


def test_of_two_runs_one_commits(spark):
    ledger = intervals.Ledger(spark, fresh_path(spark, "ledger"))
    base = ledger.read()
    ledger.commit(base, [(1, 2)], None)
    with pytest.raises(intervals.LedgerConflict):
        ledger.commit(base, [(1, 2)], None)
    assert ledger.read().done == ((1, 2),)


# Snapshots

ENTRY = "snap_id long, path string, len long, mtime_s long, mtime_ns int, seen_at timestamp_ntz, root_ord int"
T0 = "2025-01-0{} 00:00:00"


def snaps(spark, rows):
    return spark.createDataFrame(rows, "snap_id long, root_ord int, t string, fingerprint string").withColumn("taken_at", F.col("t").cast("timestamp_ntz"))


def entries(spark, rows):
    return spark.createDataFrame([(*r[:5], r[5], 77) for r in rows], ENTRY.replace("timestamp_ntz", "string")).withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


def test_paths():
    cases = {"/a/./b//c/": "/a/b/c", "/a/../../b": "/b", "a/../..": "..", "": "", ".": ".", "/": "/", "//": "/", "é/x": "é/x", "/a/b": "/a/b", "/a/...": "/a/...", "a/": "a"}
    assert {k: resolve(k) for k in cases} == cases


def test_paths_in_the_engine(spark):
    cases = ["/a/./b//c/", "/a/../../b", "..", "", "é/x", None, "/a/b", "/é", "/a/.b", "/a/..b/c"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert [r[0] for r in df.select(resolved(F.col("p"))).collect()] == [None if c is None else resolve(c) for c in cases]


def test_snapshot_changes(spark):
    s = snaps(spark, [(11, 0, T0.format(2), "b"), (10, 0, T0.format(1), "a"), (12, 0, T0.format(3), "c"), (13, 0, T0.format(4), "d"), (20, 1, T0.format(1), "e"), (21, 1, None, "f")])
    rows = [
        (10, "/x", 1, 5, 0, T0.format(1)), (10, "/x", 1, 5, 0, T0.format(1)), (10, "/y", 1, 5, 0, T0.format(1)), (10, "/n", 1, None, None, T0.format(1)),
        (11, "/x", 2, 5, 0, T0.format(1)), (11, "/a/../x", 1, 5, 0, T0.format(3)), (11, "/y", 1, 5, 1, T0.format(1)), (11, "/n", 1, None, None, None), (11, None, 1, 1, 1, None),
        (13, "/x", 1, 5, 0, T0.format(1)), (99, "/q", 1, 1, 1, None), (20, "/x", 1, 1, 1, None),
    ]
    got = {tuple(r) for r in snapdiff.snapshot_changes(entries(spark, rows), s).collect()}
    # the reading seen last says /x is as before; 12 is empty; 21 has no time, so it comes before 20
    want = {(11, "/y", "changed"), (12, "/x", "removed"), (12, "/y", "removed"), (12, "/n", "removed"), (13, "/x", "added"), (20, "/x", "added")}
    assert got == want
    assert snapdiff.snapshot_changes(entries(spark, rows).filter("false"), s).count() == 0
    assert snapdiff.snapshot_changes(entries(spark, rows), s.filter("false")).count() == 0
    sequence = spark.createDataFrame(intervals.in_sequence(s).collect(), "snap_id long, root_ord int, seq int")
    at = fresh_path(spark, "listings")
    snapdiff.keep_listings(entries(spark, rows), sequence, at)
    for only in (sequence, sequence.filter("seq IN (1, 2)")):
        kept = snapdiff.open_listings(spark, at)
        merged = snapdiff.consecutive_changes(kept.join(F.broadcast(only.select("snap_id")), "snap_id", "left_semi") if only is not sequence else kept, only)
        assert {tuple(r) for r in merged.collect()} == {w for w in want if w[0] in {r.snap_id for r in only.collect()}}
    plan = snapdiff.consecutive_changes(snapdiff.open_listings(spark, at), sequence)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "Sort" not in below  # the store is streamed where it lies


def test_long_ranges_are_streamed_whole(spark):
    s = snaps(spark, [(1, 0, T0.format(1), "a"), (2, 0, T0.format(2), "b"), (3, 0, T0.format(3), "c")])
    base = spark.range(30_000).select(F.format_string("/d%03d/f%d", F.col("id") % 997, "id").alias("path"), "id")
    every = base.crossJoin(spark.range(1, 4).toDF("snap_id")).filter("NOT (id % 100 = 0 AND snap_id = 2)")
    rows = every.select("snap_id", "path", F.when((F.col("id") % 50 == 7) & (F.col("snap_id") == 3), 2).otherwise(1).cast("long").alias("len"), F.lit(None).cast("long").alias("mtime_s"), F.lit(None).cast("int").alias("mtime_ns"), F.lit(None).cast("timestamp").alias("seen_at"))
    got = {(r.snap_id, r.change): r["count"] for r in snapdiff.snapshot_changes(rows, s).groupBy("snap_id", "change").count().collect()}
    assert got == {(2, "removed"): 300, (3, "added"): 300, (3, "changed"): 600}


def test_refresh_rows(spark):
    s = snaps(spark, [(i, 0, T0.format(i), f"A{i}") for i in range(1, 6)])
    stamps = spark.createDataFrame([(1, "a1"), (3, "A3"), (3, "A3"), (4, None), (4, "zz"), (2, "a1"), (5, "A5"), (None, "A4")], "snap_id long, fingerprint string")
    rows = [(1, "/a", 1, 1, 0, None), (2, "/a", 2, 1, 0, None), (2, "/b", 1, 1, 0, None), (3, "/a", 1, 1, 0, None), (3, "/b", 1, 1, 0, None), (4, "/b", 9, 1, 0, None), (5, "/b", 1, None, None, None), (5, "/c", None, 1, 0, None)]
    got = {tuple(r) for r in snapdiff.refresh_rows(entries(spark, rows), s, stamps).collect()}
    assert got == {(3, "/b"), (5, "/b"), (5, "/c")}
    assert snapdiff.refresh_rows(entries(spark, rows), s, stamps.filter("false")).count() == 0
    order = {r.snap_id: r.seq for r in intervals.processed_sequence(s, stamps).collect()}
    assert order == {1: 1, 3: 2, 5: 3}


def test_refresh_handles_only_what_is_new_and_late(spark):
    s = snaps(spark, [(i, i // 10, T0.format(i % 10 + 1), f"A{i}") for i in (1, 2, 3, 4, 5, 11, 12)])
    stamped = lambda *ids: spark.createDataFrame([(i, f"a{i}") for i in ids], "snap_id long, fingerprint string")
    rows = entries(spark, [(i, p, n, 1, 0, None) for i, p, n in [(1, "/a", 1), (2, "/a", 1), (2, "/b", 1), (3, "/a", 1), (3, "/b", 1), (4, "/a", 2), (4, "/b", 1), (5, "/b", 3), (11, "/a", 1), (12, "/a", 1), (12, "/z", 1)]])
    ledger = intervals.Ledger(spark, fresh_path(spark, "refresh"))
    assert snapdiff.refreshed(ledger, rows).count() == 0
    told = []
    for ids in [(1, 3), (1, 3), (1, 3, 4, 11), (1, 2, 3, 4, 11), (1, 2, 3, 4, 5, 11, 12)]:
        told.append(snapdiff.refresh_new(ledger, rows, s, stamped(*ids)))
        got = sorted(tuple(r) for r in snapdiff.refreshed(ledger, rows).collect())
        assert got == sorted(tuple(r) for r in snapdiff.refresh_rows(rows, s, stamped(*ids)).collect())
    assert told == [[(1, 1), (3, 3)], [], [(4, 4), (11, 11)], [(2, 2)], [(5, 5), (12, 12)]]
    assert got == [(2, "/b"), (4, "/a"), (5, "/b"), (12, "/z")]  # 3 lost its row when 2 came between
    assert ledger.read().done == ((1, 5), (11, 12))


def test_changes_against_brute_force(spark):
    rng = random.Random(3)
    s = snaps(spark, [(i, i % 2, T0.format(1 + i // 2), str(i)) for i in range(10)])
    rows = [(rng.randint(0, 10), f"/f{rng.randint(0, 12)}", rng.choice([1, 2, None]), rng.choice([1, None]), 0, None) for _ in range(150)]
    rows = [r if r[3] else (*r[:4], None, None) for r in rows]
    listed = {}
    for r in rows:
        key = lambda v: (-1 if v[0] is None else v[0], -1 if v[1] is None else v[1])
        old = listed.setdefault(r[0], {}).get(r[1])
        if old is None or key(r[2:4]) > key(old):
            listed[r[0]][r[1]] = r[2:4]
    want = set()
    for i in range(2, 10):
        a, b = listed.get(i - 2, {}), listed.get(i, {})
        want |= {(i, p, "added") for p in b.keys() - a.keys()} | {(i, p, "removed") for p in a.keys() - b.keys()} | {(i, p, "changed") for p in a.keys() & b.keys() if a[p] != b[p]}
    assert {tuple(r) for r in snapdiff.snapshot_changes(entries(spark, rows), s).collect()} == want


@pytest.mark.parametrize("numbers", [[], [5], [1, 2, 3], [3, 1, 9, 10, 2, 20], [None, 4, 4, 6], list(range(0, 400, 2)) + list(range(500, 900))])
def test_available_numbers(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n int").repartition(3)
    known = [n for n in numbers if n is not None]
    assert intervals.available(df, "n") == intervals.merged((n, n) for n in known)
