"""Shared spans against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spans


def brute(rows, length):
    seen = {}
    for key, text in rows:
        for i in range(len(text or "") - length + 1):
            seen.setdefault(text[i : i + length], set()).add(key)
    out = set()
    for key, text in rows:
        flags = [False] * len(text or "")
        for i in range(len(flags) - length + 1):
            if len(seen[text[i : i + length]]) > 1:
                flags[i : i + length] = [True] * length
        start = None
        for i, f in enumerate([*flags, False]):
            if f and start is None:
                start = i
            elif not f and start is not None:
                out.add((key, start, i))
                start = None
    return out


def found(spark, rows, length, gram):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lo int, hash int").repartition(3)
    got = [tuple(r) for r in spans.shared_spans(df, length=length, gram=gram).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("gram,piece", [(5, 1 << 19), (12, 64), (1, 100)])
def test_spans(spark, monkeypatch, gram, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    spans._POWERS.clear()
    rng = random.Random(gram)
    word = lambda: "".join(rng.choices("abé中😀 \n", k=rng.randint(3, 30)))
    pool = [word() for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else word() for _ in range(rng.randint(0, 12)))) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "z" * 200), (104, "z" * 150), (105, "only here " * 9), (106, rows[3][1]), (107, rows[3][1])]
    assert found(spark, rows, 12, gram) == brute(rows, 12)
    spans._POWERS.clear()


def test_a_text_that_many_hold(spark):
    """A third of all rows are copies of one text; one of them goes on."""
    text = "".join(random.Random(1).choices("abcdefgh", k=90))
    rows = [(i, text) for i in range(30)] + [(50, "x" + text + "y"), (51, text[:45]), (60, "unlike " + "qrst" * 30)]
    assert found(spark, rows, 40, 16) == brute(rows, 40) == {(i, 0, 90) for i in range(30)} | {(50, 1, 91), (51, 0, 45)}


def test_repeats_within_one_record_alone(spark):
    rows = [(1, "abcdefghijkl" * 4), (2, "mnopqrstuvwx" * 4), (None, "abcdefghijkl" * 4)]
    assert found(spark, rows, 12, 4) == set()
    assert found(spark, [], 12, 4) == set()


def test_rows_of_one_record_do_not_share(spark):
    assert found(spark, [(1, "abcdefghijklmnop"), (1, "abcdefghijklmnop")], 12, 4) == set()


def test_share(spark):
    rows = [(1, "0123456789abcdef"), (2, "xx0123456789ab"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in spans.shared_share(df, length=12).collect()} if spans.GRAM <= 12 else None
    if got is None:
        with pytest.raises(ValueError):
            spans.shared_share(df, length=12)
        long = spark.createDataFrame([(1, "a1" * 100), (2, "b" + "a1" * 100), (3, None), (4, "")], "doc_id long, text string")
        got = {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shared_share(long).collect()}
        assert got == {1: (200, 200), 2: (201, 200), 3: (0, 0), 4: (0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=60), st.integers(1, 20))
def test_hashes_of_stretches(text, k):
    import numpy as np

    h = spans.Rolling(text + "|" + text)
    n = len(text)
    every = h.every(k)
    assert len(every) == max(0, 2 * n + 1 - k + 1) or k > 2 * n + 1
    for i in range(max(0, n - k + 1)):
        assert every[i] == every[n + 1 + i] == h.between(np.array([i]), np.array([i + k]))[0]
