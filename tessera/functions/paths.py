"""Spelling of paths: resolved, and composed to NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def resolve(path: str) -> str:
    """Resolve ``.``, ``..``, repeated and trailing ``/``; compose to NFC.

    ``..`` above the top of an absolute path stays at the top; at the front of a
    relative path it is kept. The empty path stays empty; a relative path that
    resolves to nothing becomes ``.``.
    """
    if not path:
        return path
    path = unicodedata.normalize("NFC", path)
    absolute = path.startswith("/")
    kept: list[str] = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part != "..":
            kept.append(part)
        elif kept and kept[-1] != "..":
            kept.pop()
        elif not absolute:
            kept.append(part)
    return ("/" if absolute else "") + "/".join(kept) or "."


@F.pandas_udf(StringType())
def _resolve_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for paths in batches:
        yield paths.map(resolve, na_action="ignore")


def _needs_work(path: Column) -> Column:
    """Plain searches of bytes, which cost far less than an expression would."""
    inner = [F.contains(path, F.lit(x)) for x in ("//", "/./", "/../")]
    ends = [F.endswith(path, F.lit(x)) for x in ("/.", "/..")] + [F.startswith(path, F.lit(x)) for x in ("./", "../")]
    bare = [path.isin(".", ".."), F.endswith(path, F.lit("/")) & (path != "/"), F.octet_length(path) != F.length(path)]
    return reduce(lambda a, b: a | b, [*inner, *ends, *bare])


def resolved(path: Column) -> Column:
    """``resolve`` as a column. Clean ASCII paths never leave the JVM with their
    text: the Arrow function gets null for them."""
    return F.coalesce(_resolve_udf(F.when(_needs_work(path), path)), path)
