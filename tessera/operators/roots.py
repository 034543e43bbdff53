"""Which roots an index covers: one inside another, and what a run asks to add or drop."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.listing import GIT, WALK, Root


def is_within(child: str, parent: str) -> bool:
    """Whether ``child`` is ``parent`` or lies below it, by their spelling alone."""
    return child == parent or child.startswith(parent if parent.endswith(("/", "\\")) else (parent + "/", parent + "\\"))


def within(child: Column, parent: Column) -> Column:
    return (child == parent) | F.startswith(child, F.concat(F.rtrim(parent, F.lit("/")), F.lit("/")))


def collapse(roots: DataFrame) -> DataFrame:
    """(path, source, covered_by): each path once, with the outermost root above it, or null
    where there is none. Of rows with one path the least source counts; null paths are left
    out.

    A path's ancestors are few, so each path is exploded to them and joined by equality: no
    path is compared with all others.
    """
    once = roots.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min("source").alias("source"))
    parts = F.split("path", "/")
    above = once.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    above = above.withColumn("up", F.when(F.col("up") == "", F.lit("/")).otherwise(F.col("up"))).filter(F.col("up") != F.col("path"))
    outer = above.join(once.select(F.col("path").alias("up")), "up").groupBy("path").agg(F.min_by("up", F.length("up")).alias("covered_by"))
    return once.join(outer, "path", "left").select("path", "source", "covered_by")


def collapse_list(roots: list[Root]) -> tuple[list[Root], list[tuple[str, str]]]:
    """The same for the few roots of one index: those kept, and (dropped, kept above it)."""
    kept: list[Root] = []
    dropped: list[tuple[str, str]] = []
    for path, root in sorted({r.path: r for r in reversed(roots)}.items()):
        over = next((k.path for k in kept if is_within(path, k.path)), None)
        if over is None:
            kept.append(root)
        else:
            dropped.append((path, over))
    return kept, dropped


@dataclass
class RootPlan:
    roots: list[Root]
    notes: list[str] = field(default_factory=list)


def plan_roots(
    stored: list[Root],
    add: list[str] | None = None,
    local: str | None = None,
    remove: list[str] | None = None,
    source: str | None = None,
    is_dir: Callable[[str], bool] = os.path.isdir,
    real: Callable[[str], str] = os.path.realpath,
    is_repository: Callable[[str], bool] = lambda p: os.path.exists(os.path.join(p, ".git")),
) -> RootPlan:
    """The roots of the next build.

    Stored roots stay, but for those to remove and those that are gone; named ones, which
    must exist, are added. A root's source is, first, the one asked for, if the root is
    named in this run or none is; else the one it has; else git for a repository that is
    the local root; else a walk.
    """
    notes: list[str] = []
    named = [*(add or []), *([local] if local else [])]
    for p in named:
        if not is_dir(p):
            raise NotADirectoryError(f"{p}: not a directory")
    bare = lambda p: p.rstrip("/")
    unwanted = {bare(real(p) if is_dir(p) else p): p for p in remove or []}
    have = {bare(r.path) for r in stored}
    notes += [f"{p}: not in the index" for b, p in unwanted.items() if b not in have]
    wanted: dict[str, Root] = {}
    for r in stored:
        if bare(r.path) in unwanted:
            notes.append(f"{r.path}: removed")
        elif not is_dir(r.path):
            notes.append(f"{r.path}: is gone; taken off the list of roots")
        else:
            path = real(r.path)
            wanted[bare(path)] = Root(path, source if source and not named else r.source)
    at_home = bare(real(local)) if local else None
    for p in named:
        path = real(p)
        known = wanted.get(bare(path))
        first = GIT if bare(path) == at_home and is_repository(path) else WALK
        wanted[bare(path)] = Root(known.path if known else path, source or (known.source if known else first))
    kept, dropped = collapse_list(list(wanted.values()))
    return RootPlan(kept, notes + [f"{c}: left to {p}, which holds it" for c, p in dropped])
