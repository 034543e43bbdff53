"""Holding two searches' counts against each other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_line(line: str, corpus: str) -> tuple[str, int] | None:
    """``path:count`` with the path made relative to ``corpus``; None for anything else."""
    path, colon, n = line.rstrip("\r\n").rpartition(":")
    if not colon or not n.isdigit():
        return None
    return path.removeprefix(corpus.rstrip("/") + "/"), int(n)


def patterns(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """(expression, ignore case) of a pattern file: blank lines and ``#`` comments aside,
    ``-i `` before an expression ignores case."""
    kept = [x.rstrip("\r\n") for x in lines if x.strip() and not x.lstrip().startswith("#")]
    return [(x[3:], True) if x.startswith("-i ") else (x, False) for x in kept]


def timed(work: Callable[[], object], runs: int = 5) -> tuple[float, float]:
    """(least, median) seconds, after one run that doesn't count."""
    work()
    seconds = []
    for _ in range(runs):
        began = time.perf_counter()
        work()
        seconds.append(time.perf_counter() - began)
    return min(seconds), median(seconds)


def differences(left: DataFrame, right: DataFrame, key: str = "path", count: str = "n") -> DataFrame:
    """(key, left_n, right_n, kind): where the counts differ, ``only left``, ``only right``
    or ``count``. A missing count is no file; equal nulls agree."""
    a = left.select(key, F.col(count).alias("left_n"), F.lit(True).alias("_a"))
    b = right.select(key, F.col(count).alias("right_n"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), F.lit("only left")).when(F.col("_a").isNull(), F.lit("only right")).when(~F.col("left_n").eqNullSafe(F.col("right_n")), F.lit("count"))
    return a.join(b, key, "full").withColumn("kind", kind).filter("kind IS NOT NULL").select(key, "left_n", "right_n", "kind")
