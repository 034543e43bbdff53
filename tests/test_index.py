"""Trigrams, skip reasons, and the index as a folder of tables."""

import json
import os
import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import search_queries
from tessera.functions import trigrams
from tessera.plans.analyze import regexp_query
from tessera.plans.candidates import GramCounts, choose, ranges_of
from tessera.runtime import SharedFolder, shared_dir
from tessera.sources import index
from tessera.sources.listing import Root, snapshot

CORPUS = {"a.txt": b"hello world\nfoo bar baz\n", "b.txt": b"goodbye world\n", "sub/c.rs": b'fn main() { println!("hello"); }\n', "bin.dat": b"abc\0def", ".hidden": b"hello hidden", "tiny": b"hi"}


def write(folder, files):
    for name, content in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return str(folder)


def build(spark, root, at, contents=None):
    snap = snapshot([Root(root)])
    roots = spark.createDataFrame([(0, root, "walk")], index.TABLES["roots"])
    return index.build_index(spark, at, snap.to_df(spark), roots, contents, snap.too_large)


def test_trigram_sets():
    assert [trigrams.packed(b"hello").tolist()] == [[0x68656C, 0x656C6C, 0x6C6C6F]]
    assert trigrams.analyze(b"hi") [0] is None and not len(trigrams.analyze(b"hi")[1])
    data = bytes(random.Random(1).choices(b"abcdefghij\n", k=300_000))
    assert set(trigrams.distinct_trigrams(data).tolist()) == {int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)}


@pytest.mark.parametrize(
    "content,reason",
    [(b"a\0b", trigrams.BINARY), (b"\xff\xfeA", trigrams.INVALID), (b"x" * 2001, trigrams.LONG_LINE), (b"x" * 2000, None), (b"x" * 2000 + b"\n" + b"y" * 2000, None), (b"x" * 1999 + b"\r\n" + b"y", None), (b"x" * 2000 + b"\r\ny", trigrams.LONG_LINE), (b"ok\n" + b"x" * 2001, trigrams.LONG_LINE), (b"\xff\0" + b"x" * 3000, trigrams.BINARY), (None, trigrams.UNREADABLE), (b"", None)],
)
def test_skip_reasons(spark, content, reason):
    assert trigrams.analyze(content)[0] == reason
    df = spark.createDataFrame([(content,)], "c binary")
    assert df.select(trigrams.skip_reason(F.col("c"))).first()[0] == reason


def test_too_many_trigrams():
    text = b"".join(bytes([65 + a, 97 + b, 48 + c, 10]) for a in range(26) for b in range(26) for c in range(40))
    assert trigrams.analyze(text)[0] == trigrams.TOO_MANY


def test_skip_reasons_are_those_of_the_index(spark, tmp_path):
    many = "".join(f"{chr(65 + a)}{chr(97 + b)}{chr(48 + c)}\n" for a in range(26) for b in range(26) for c in range(40))
    texts = [many, many.replace("\n", ""), "short", "", None, "a\0b"]
    docs = spark.createDataFrame([(i, t, f"a{i}.txt") for i, t in enumerate(texts)], "doc_id long, text string, path string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.reason for r in search_queries.skip_reasons(spark, str(tmp_path)).collect()}
    assert got == {0: trigrams.TOO_MANY, 1: trigrams.LONG_LINE, 2: None, 3: None, 4: trigrams.UNREADABLE, 5: trigrams.BINARY}
    assert got == {r.doc_id: r.reason for r in search_queries._grams(spark, str(tmp_path)).collect()}


def test_built_in_trigrams_agree(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "naïve ünï"), (3, "hi"), (4, ""), (5, None), (6, "aaaaaa")], "id int, t string")
    got = {r.id: r.g for r in df.select("id", trigrams.trigram_array(F.col("t")).alias("g")).collect()}
    want = {r.id: r.grams for r in trigrams.analyzed(df, "id", "t").collect()}
    assert got.pop(5) is None and want.pop(5) == [] and got == want


def test_round_trip(spark, tmp_path):
    root = write(tmp_path / "r", CORPUS)
    built = build(spark, root, str(tmp_path / "ix"))
    assert (built.stats.files_seen, built.stats.files_indexed, built.stats.files_skipped) == (5, 4, 1)
    ix = index.open_index(spark, str(tmp_path / "ix"), validate=True)
    assert ix.posting_count(0x68656C) == 2 and ix.num_files == 4 and ix.posting_count(0x7A7A7A) == 0
    names = lambda p, **k: [r.path.removeprefix(root + "/") for r in ix.search_files(p, **k).collect()]
    assert names("hello wor") == ["a.txt"] and names("world") == ["a.txt", "b.txt"] and names("nothing_here") == []
    assert names("hello|goodbye") == ["a.txt", "b.txt", "sub/c.rs"] == names("hello|goodbye", brute=True)
    assert names("HELLO", ignore_case=True) == ["a.txt", "sub/c.rs"] and names("hello", name=r"\.rs$") == ["sub/c.rs"]
    assert [r.path for r in ix.names(spark.createDataFrame([(0,), (9,)], "file_id long")).orderBy("file_id").collect()] == [f"{root}/a.txt", ""]
    assert [r.n for r in ix.search_counts("o").collect()] == [2, 1, 1]
    assert [(r.line_no, r.line) for r in ix.search_lines("ba[rz]").collect()] == [(2, "foo bar baz")]
    assert ix.explain_search("hello").first().asDict() == {"query": "ell hel llo", "candidates": 2, "files": 4}
    os.remove(f"{root}/a.txt")
    assert names("hello") == ["sub/c.rs"]  # current contents count
    assert ix.lost_files(ix.candidate_files("hello")).first().missing == 1


def test_results_in_order(spark, tmp_path):
    root = write(tmp_path / "r", {f"f{i:03d}.txt": b"x" * ((i * 37) % 1500) + b"\nneedle %d\n" % i for i in range(120)})
    ix = build(spark, root, str(tmp_path / "ix"))
    got = ix.search_counts("needle").collect()
    assert [r.path for r in got] == sorted(r.path for r in got) and len(got) == 120 and {r.n for r in got} == {1}


def test_components_order_ids(spark):
    df = spark.createDataFrame([(1, "/r/a-b/c"), (1, "/r/a/b"), (0, "/z"), (1, "/r/a"), (1, None)], "root_ord int, path string")
    rows = index.dense_ids(df, [F.col("root_ord"), F.split("path", "/")], "id").orderBy("id").collect()
    assert [r.path for r in rows] == ["/z", None, "/r/a", "/r/a/b", "/r/a-b/c"] and [r.id for r in rows] == [0, 1, 2, 3, 4]


def test_replaced_as_a_whole(spark, tmp_path):
    root, at = write(tmp_path / "r", CORPUS), str(tmp_path / "ix")
    old = build(spark, root, at)
    (tmp_path / "r" / "new.txt").write_bytes(b"quite new\n")

    def fail():
        raise RuntimeError("died before the build counted")

    snap = snapshot([Root(root)])
    with pytest.raises(RuntimeError):
        index.build_index(spark, at, snap.to_df(spark), old.table("roots"), before_commit=fail)
    assert index.open_index(spark, at).meta == old.meta
    build(spark, root, at)
    assert index.open_index(spark, at).num_files == 5
    assert old.search_counts("hello").count() == 2  # a reader of the build before isn't disturbed
    index.drop_abandoned(spark, at)
    assert sum(n.startswith("v-") for n in SharedFolder(spark, at).names()) == 2
    index.reset_index(spark, at)
    with pytest.raises(index.IndexFormatError):
        index.open_index(spark, at)


def test_damage_is_named(spark, tmp_path):
    root, at = write(tmp_path / "r", CORPUS), tmp_path / "ix"
    ix = build(spark, root, str(at))
    record = next(at.glob("current-*.json"))
    meta = json.loads(record.read_text())

    def refuse(change):
        crc = record.with_name(f".{record.name}.crc")
        crc.unlink(missing_ok=True)
        record.write_text(change if isinstance(change, str) else json.dumps(change))
        with pytest.raises(index.IndexFormatError, match=str(at)):
            index.open_index(spark, str(at), validate=True)

    refuse("not a record")
    refuse("[]")
    refuse(meta | {"family": "other"})
    refuse(meta | {"version": 99})
    for name in index.TABLES:
        refuse(meta | {"rows": meta["rows"] | {name: meta["rows"][name] + 1}})
    record.write_text(json.dumps(meta))
    assert index.open_index(spark, str(at), validate=True).num_files == 4
    base = at / ix.meta["build"]

    def swapped(name, df, rows=None):
        kept = tmp_path / "kept"
        shutil.copytree(base / name, kept)
        new = df.collect()
        spark.createDataFrame(new, df.schema).write.mode("overwrite").parquet(str(base / name))
        record.write_text(json.dumps(meta | {"rows": meta["rows"] | {name: len(new)}}))
        with pytest.raises(index.IndexFormatError, match=str(at)):
            index.open_index(spark, str(at), validate=True)
        shutil.rmtree(base / name)
        shutil.move(kept, base / name)
        record.write_text(json.dumps(meta))

    p = ix.table("postings")
    swapped("postings", p.withColumn("ids", F.transform("ids", lambda x: x + 99)).withColumn("first", F.col("first") + 99))
    swapped("postings", p.unionByName(p.limit(1)))
    swapped("postings", p.withColumn("n", F.col("n") + 1))
    swapped("postings", p.limit(3))
    swapped("postings", p.withColumn("trigram", F.lit(1 << 25)))
    swapped("gram_counts", ix.table("gram_counts").withColumn("n_files", F.lit(7).cast("long")))
    swapped("files", ix.table("files").withColumn("file_id", F.col("file_id") * 2))
    swapped("files", ix.table("files").withColumnRenamed("path", "name"))
    shutil.rmtree(base / "skips")
    refuse(meta)


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "r").mkdir()
    ix = build(spark, str(tmp_path / "r"), str(tmp_path / "ix"))
    assert index.open_index(spark, str(tmp_path / "ix"), validate=True).num_files == 0
    assert ix.search_files("a").count() == 0 and ix.search_lines(".", brute=True).count() == 0


def test_posting_lists_are_cut(spark):
    grams = spark.createDataFrame([(5, [1, 2]), (2, [1]), (12, [1]), (None, [3]), (7, []), (8, None)], "file_id long, grams array<int>").coalesce(1)
    rows = lambda **k: sorted((r.trigram, r.first, r.n, r.ids) for r in trigrams.posting_lists(grams, "file_id", **k).collect())
    assert rows() == [(1, 2, 3, [2, 5, 12]), (2, 5, 1, [5])]
    assert rows(listed=2) == [(1, 2, 2, [2, 5]), (1, 12, 1, [12]), (2, 5, 1, [5])]
    got = sorted((r.trigram, r.block, r.cnt, r.first_id, r.last_id) for r in index.posting_blocks(trigrams.posting_lists(grams, "file_id"), block=10).collect())
    assert got == [(1, 0, 2, 2, 5), (1, 1, 1, 12, 12), (2, 0, 1, 5, 5)]


def test_ways_of_reading_agree(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = {i: " ".join(words[k] for k in range(5) if i >> k & 1) for i in range(1, 400)}
    files = spark.createDataFrame(list(texts.items()), "file_id long, text string").cache()
    grams = trigrams.analyzed(files, "file_id", "text")
    lists = trigrams.posting_lists(grams, "file_id")
    counts = GramCounts(index.gram_counts(lists))
    for pattern in ("alpha.*omega", "(alpha|gamma) delta", "beta", "zeta", "x|y", "omega (beta|delta)|gam"):
        q = regexp_query(pattern)
        want = {i for i, t in texts.items() if re.search(pattern, t)}
        for few, exact in ((4096, True), (4096, False), (3, True), (3, False)):
            chosen = choose(lists, q, lambda: files, counts, len(texts), few=few, exact=exact)
            got = {r.file_id for r in chosen.of(files, "file_id").collect()}
            assert got >= want and (not exact or got == {i for i, t in texts.items() if q.holds(set(trigrams.distinct_trigrams(t.encode()).tolist()))}), (pattern, few, exact)
    assert ranges_of(np.array([1, 2, 9, 10, 50]), 2) == [(1, 10), (50, 50)] and ranges_of(np.array([4]), 9) == [(4, 4)] and ranges_of(np.array([])) == []


def test_contents_are_handed_on_by_bytes(spark, tmp_path):
    root = write(tmp_path / "r", {f"f{i}": bytes([65 + i]) * 100 for i in range(9)})
    rows = spark.createDataFrame([(i, f"{root}/f{i}" if i < 9 else "file://" + f"{root}/f{i - 9}" if i < 12 else f"{root}/none") for i in range(13)], "id int, path string").coalesce(1)
    for size in (1, 250, 1 << 20):
        got = {r.id: (r.content, r.lost) for r in index.read_contents(rows, size).collect()}
        assert [len(got[i][0]) for i in range(12)] == [100] * 12 and got[12] == (None, "missing") and got[9] == got[0]


def test_shared_folder(spark):
    f = SharedFolder(spark, f"{shared_dir(spark)}/folder-test")
    assert f.create("a", "one") and not f.create("a", "two") and f.read("a") == "one" and f.names() == ["a"]
    assert np.array_equal([f.exists("a"), f.exists("b")], [True, False])
    f.remove()
    assert f.names() == []
