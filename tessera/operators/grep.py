"""Matching lines of texts, as line-oriented search tools report them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import hir
from tessera.plans.translate import line_local, to_java, to_python


def hits(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int, int]]:
    """(line number, start, end) of each hit: at most one per line, a match over several
    lines being one hit on all of them. What follows a final line end is no line."""
    at, line, counted = 0, 1, 0
    no_more = not text or text.endswith("\n")
    while at < len(text) and (m := pattern.search(text, at)):
        if no_more and m.start() == len(text):
            return
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        line += text.count("\n", counted, start)
        counted = start
        yield line, start, end
        at = end + 1


def literal(text: str) -> str:
    """``text`` as an SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Plans are written as SQL text: a search of few files is over sooner than a plan is put
# together column by column.


def _lines_of(content: str) -> str:
    """The lines, each as it stands; none for an empty text."""
    body = f"IF(endswith({content}, '\\n'), substring({content}, 1, length({content}) - 1), {content})"
    return f"IF(length({content}) > 0, split({body}, '\\n', -1), CAST(array() AS array<string>))"


def _line_test(java: str) -> str:
    return f"regexp_replace(l, {literal(chr(92) + 'r' + chr(92) + 'z')}, '') RLIKE {literal(java)}"


def _with_text(texts: DataFrame, key: str, content: str, test: str = "true") -> DataFrame:
    return texts.selectExpr(f"`{key}` AS _key", f"`{content}` AS _text").filter(f"_text IS NOT NULL AND {test}")


def _looped(node: hir.Node, lines: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    source = to_python(node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(source)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            if lines:
                rows = [(i, n, t[a:b]) for i, t in enumerate(texts) for n, a, b in hits(pattern, t)]
                at, no, line = (list(x) for x in zip(*rows)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), pa.array(line, pa.string())], names=["_key", "line_no", "line"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array([sum(1 for _ in hits(pattern, t)) for t in texts], pa.int64())], names=["_key", "n"])

    return run


def matching_lines(texts: DataFrame, pattern: str, key: str, content: str, ignore_case: bool = False) -> DataFrame:
    """(key, line_no, line): every hit. Null texts have none.

    Expressions that cannot see past a line are tested line by line inside the engine;
    others run over whole texts in Python workers, after the engine has passed over the
    texts without any match.
    """
    node = hir.parse(pattern, ignore_case)
    java = to_java(node)
    if line_local(node):
        each = _with_text(texts, key, content).selectExpr("_key", f"posexplode({_lines_of('_text')}) AS (at, l)")
        return each.filter(_line_test(java)).selectExpr(f"_key AS `{key}`", "CAST(at + 1 AS BIGINT) AS line_no", "l AS line")
    schema = T.StructType([T.StructField("_key", texts.schema[key].dataType), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
    rows = _with_text(texts, key, content, f"_text RLIKE {literal(java)}")
    return rows.mapInArrow(_looped(node, True), schema).withColumnRenamed("_key", key)


def match_counts(texts: DataFrame, pattern: str, key: str, content: str, ignore_case: bool = False) -> DataFrame:
    """(key, n): the number of hits of each text that has any; no shuffle."""
    node = hir.parse(pattern, ignore_case)
    java = to_java(node)
    if line_local(node):
        n = f"CAST(size(filter({_lines_of('_text')}, l -> {_line_test(java)})) AS BIGINT) AS n"
        return _with_text(texts, key, content).selectExpr(f"_key AS `{key}`", n).filter("n > 0")
    schema = T.StructType([T.StructField("_key", texts.schema[key].dataType), T.StructField("n", T.LongType())])
    rows = _with_text(texts, key, content, f"_text RLIKE {literal(java)}")
    return rows.mapInArrow(_looped(node, False), schema).filter("n > 0").withColumnRenamed("_key", key)


def matching_files(texts: DataFrame, pattern: str, key: str, content: str, ignore_case: bool = False) -> DataFrame:
    """(key): the texts with a hit. A line-local test stops at the first one."""
    node = hir.parse(pattern, ignore_case)
    if not line_local(node):
        return match_counts(texts, pattern, key, content, ignore_case).select(key)
    return _with_text(texts, key, content, f"exists({_lines_of('_text')}, l -> {_line_test(to_java(node))})").selectExpr(f"_key AS `{key}`")


def rendered(mode: str, names: bool = True, numbers: bool = False) -> Column:
    """A result row as a line of text: of ``files`` the path, of ``counts`` the count, of
    ``lines`` the line, with the path and the line's number before it if asked for."""
    if mode == "files":
        return F.col("path")
    parts = [F.col("path")] * names + ([F.col("n").cast("string")] if mode == "counts" else [F.col("line_no").cast("string")] * numbers + [F.col("line")])
    return F.concat_ws(":", *parts)


def name_filter(names: DataFrame, pattern: str, column: str = "path") -> DataFrame:
    """Names that the expression occurs in: never case-insensitive, and text anchors only."""
    return names.filter(F.col(column).rlike(to_java(hir.parse(pattern, multi_line=False, crlf=False))))
