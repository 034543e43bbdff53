"""Parsing, analysis and translation of expressions, and evaluation of their queries."""

import re
import string

import pytest
from goldens import HITS, QUERIES
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.trigrams import distinct_trigrams
from tessera.operators import grep
from tessera.plans import hir
from tessera.plans.analyze import regexp_query
from tessera.plans.boolquery import AND, EVERYTHING, NOTHING, OR, Query, all_of
from tessera.plans.candidates import candidates
from tessera.plans.translate import line_local, to_java, to_python


@pytest.mark.parametrize("pattern,query", QUERIES)
def test_printed_queries(pattern, query):
    assert str(regexp_query(pattern)) == query


def test_printed_query_without_case():
    assert str(regexp_query("abc", True)) == "(ABC|ABc|AbC|Abc|aBC|aBc|abC|abc)"


def test_folding_is_unicode():
    assert hir.parse("k", True) == hir.Class(((0x4B, 0x4B), (0x6B, 0x6B), (0x212A, 0x212A)))
    assert {0x73, 0x53, 0x17F} == {c for lo, hi in hir.parse("S", True).ranges for c in range(lo, hi + 1)}


@pytest.mark.parametrize("bad", ["(", ")", "[a", "*a", "a{2,1}", r"\1", "(?=a)", "(?<!a)", r"\p{Nonsense}", "a{1001}", r"\q", "(?-u:a)", "[b-a]"])
def test_rejected(bad):
    with pytest.raises(hir.PatternError):
        hir.parse(bad)


@pytest.mark.parametrize(
    "a,b",
    [("a|b", "[ab]"), ("(?:ab)(?:cd)", "abcd"), ("a{1}", "a"), ("[[:digit:]&&[^5-9]]", "[0-4]"), (r"[a-f--c]", "[abd-f]"), (r"\x{61}b", "ab"), ("(?i)a(?-i)b", "[aA]b"), ("(?x) a b # c", "ab"), (r"a{0}b", "b")],
)
def test_normal_forms(a, b):
    assert hir.parse(a) == hir.parse(b)


def test_boolean_algebra():
    a, b, c = (all_of([x]) for x in (b"abc", b"abd", b"abe"))
    assert (a & NOTHING).kind == "none" and (a | EVERYTHING).kind == "all" and str(a | NOTHING) == str(a) == str(a & EVERYTHING) == "abc"
    assert str((a | b) & (a | c)) == "(abc)|(abd abe)"
    assert str(Query(AND)) == "" and str(Query(AND) & a) == "abc" and str(Query(OR) | a) == "abc"
    assert sorted((a & b).leaves()) == [0x616263, 0x616264]


@pytest.mark.parametrize("pattern,local", [("abc", True), ("a.c$", True), ("[^x]", False), (r"\s", False), (r"a\nb", False), (r"\Aa", False), ("(?s)a.b", False), (r"\bword\b", True)])
def test_line_local(pattern, local):
    assert line_local(hir.parse(pattern)) is local


@pytest.mark.parametrize("pattern,text,n", HITS)
def test_hits_in_python(pattern, text, n):
    assert sum(1 for _ in grep.hits(re.compile(to_python(hir.parse(pattern))), text)) == n


def test_hits_in_the_engine(spark):
    for pattern in sorted({p for p, _, _ in HITS}):
        rows = [(i, t) for i, (p, t, _) in enumerate(HITS) if p == pattern]
        df = spark.createDataFrame(rows, "id int, t string")
        want = {i: HITS[i][2] for i, _ in rows if HITS[i][2]}
        assert {r.id: r.n for r in grep.match_counts(df, pattern, "id", "t").collect()} == want
        assert {r.id for r in grep.matching_files(df, pattern, "id", "t").collect()} == set(want)
        # a pattern with an alternative that is not line-local goes the other way
        other = rf"(?:{pattern})|\n\n\n\n\n\z"
        assert {r.id: r.n for r in grep.match_counts(df, other, "id", "t").collect()} == want


def test_lines_and_numbers(spark):
    text = "hit one\nmiss\nmiss\nhit four\n\n\nhit 7, hit again\nmiss\nhit nine"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    want = [(1, "hit one"), (4, "hit four"), (7, "hit 7, hit again"), (9, "hit nine")]
    for pattern in ("hit", r"hit|\n\n\n\z"):
        got = grep.matching_lines(df, pattern, "id", "t").orderBy("line_no").collect()
        assert [(r.line_no, r.line) for r in got] == want
    crossing = grep.matching_lines(df, r"four\n+hit", "id", "t").collect()
    assert [(r.line_no, r.line) for r in crossing] == [(4, "hit four\n\n\nhit 7, hit again")]


def test_word_classes_agree(spark):
    texts = ["naïve", "x", "é", " ", "_", "٣", "a b", "K", "中文 字", "a-b", "€"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for pattern in (r"^\w+$", r"\bn", r"\d", r"\S\w", r"[^\W\d]", r"\B.", "(?i)k", r"\p{Greek}|\pL\pL", r"[[:alpha:]]"):
        node = hir.parse(pattern)
        want = {i for i, t in enumerate(texts) if re.search(to_python(node), t)}
        assert {r.id for r in df.filter(F.col("t").rlike(to_java(node))).collect()} == want, pattern


def test_names_are_filtered_without_flags(spark):
    df = spark.createDataFrame([("a/B.rs",), ("a/b.rs",), ("a/b.rs.txt",), (None,)], "path string")
    assert [r.path for r in grep.name_filter(df, r"b\.rs$").collect()] == ["a/b.rs"]


# The one promise: no file that matches is passed over

LETTERS = "abcdefghijkl"
words = st.text(LETTERS, min_size=1, max_size=7)
lines = st.lists(words, min_size=1, max_size=6).map(" ".join)
texts = st.tuples(st.lists(lines, min_size=1, max_size=8), st.sampled_from(["\n", "\r\n"]), st.booleans()).map(lambda x: x[1].join(x[0]) + (x[1] if x[2] else ""))
atoms = st.one_of(words, st.sampled_from(["[abc]", "[a-d]", "[^x]", ".", r"\w", r"\s"]))


@st.composite
def patterns(draw):
    parts = []
    for _ in range(draw(st.integers(1, 3))):
        a = draw(atoms)
        if draw(st.integers(0, 9)) < 3:
            a = f"(?:{a}){draw(st.sampled_from(['*', '+', '?', '{2}', '{1,3}', '{2,}']))}"
        parts.append(a)
    p = "".join(parts)
    if draw(st.integers(0, 3)) == 0:
        p = f"{p}|{draw(words)}"
    p = draw(st.sampled_from(["", "", "", "^", r"\b"])) + f"(?:{p})" + draw(st.sampled_from(["", "", "", "$", r"\b"]))
    return draw(st.sampled_from(["", "", "(?i)"])) + p


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(pattern=patterns(), corpus=st.lists(texts, min_size=1, max_size=6))
def test_candidates_hold_all_matches(pattern, corpus):
    query = regexp_query(pattern)
    found = re.compile(to_python(hir.parse(pattern)))
    for text in corpus:
        if any(True for _ in grep.hits(found, text)):
            assert query.holds(set(distinct_trigrams(text.encode()).tolist())), (pattern, str(query), text)


def test_pruning_is_not_vacuous():
    corpus = [w * 2 + " " + w[::-1] for w in ("abcdef", "ghijkl", "acegik", "bdfhjl")]
    queries = [regexp_query(p) for p in ("bcde", "gikace", "hj.*lj", "[a-c]bcdefa", "zzz")]
    tests = [q.holds(set(distinct_trigrams(t.encode()).tolist())) for q in queries for t in corpus]
    assert 0.2 < sum(tests) / len(tests) < 0.8


def test_engine_evaluates_queries(spark):
    corpus = {i: t for i, t in enumerate(["hello world", "goodbye world", "hello there", "hi", "", string.ascii_letters * 3])}
    postings = spark.createDataFrame([(int(g), i) for i, t in corpus.items() for g in distinct_trigrams(t.encode())], "trigram int, file_id long")
    files = spark.createDataFrame([(i,) for i in corpus], "file_id long")
    counts = postings.groupBy("trigram").agg(F.count("*").alias("n_files"))
    for pattern in ("hello", "hello|goodbye", "hel.*(wor|the)", ".", "nothing_here", "[a-z]{80}", "(?i)world", "abc?def", string.ascii_letters + string.ascii_letters, r"[^\s\S]"):
        q = regexp_query(pattern)
        want = {i for i, t in corpus.items() if q.holds(set(distinct_trigrams(t.encode()).tolist()))}
        for c in (None, counts):
            got = [r.file_id for r in candidates(postings, q, files, c).collect()]
            assert set(got) == want and len(got) == len(want), pattern
