"""Keeping an index: where it is, what it covers, and when it is built anew."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.control import stamp, turns
from tessera.control.readonly import is_read_only
from tessera.operators.roots import is_within, plan_roots
from tessera.runtime import SharedFolder
from tessera.sources import index as store
from tessera.sources import perforce
from tessera.sources.listing import SOURCES, ListingError, Root, git, snapshot

INDEX_NAME = ".tessera-index"
INDEX_VARIABLE = "TESSERA_INDEX"


def resolve_index_path(explicit: str | None = None, variable: str | None = None, cwd: str | None = None, home: str | None = None) -> str:
    """An explicit path; else the variable's; else the nearest index at or above ``cwd``;
    else the one in the home folder."""
    if explicit or variable:
        return explicit or variable or ""
    here = cwd
    while here:
        if os.path.isdir(os.path.join(here, INDEX_NAME)):
            return os.path.join(here, INDEX_NAME)
        here = os.path.dirname(here) if os.path.dirname(here) != here else None
    return os.path.join(home or ".", INDEX_NAME)


def local_root(cwd: str, p4: bool = False) -> str:
    """The root of the repository (or Perforce workspace) around ``cwd``; else ``cwd``."""
    if p4:
        return perforce.workspace_root(cwd)
    here = os.path.realpath(cwd)
    while not os.path.exists(os.path.join(here, ".git")):
        if os.path.dirname(here) == here:
            return os.path.realpath(cwd)
        here = os.path.dirname(here)
    return here


def exclude_from_git(root: str, index: str) -> bool:
    """Keep the index out of git's sight, once; before files are listed. Returns whether a
    line was added."""
    out = git(root, "rev-parse", "--git-path", "info/exclude")
    if out.returncode or not is_within(index, root):
        return False
    path = os.path.join(root, out.stdout.decode().strip())
    line = "/" + os.path.relpath(index, root) + "*"
    try:
        with open(path, encoding="utf-8") as f:
            had = f.read()
    except OSError:
        had = ""
    if line in had.splitlines():
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(("" if not had or had.endswith("\n") else "\n") + line + "\n")
    return True


@dataclass
class Outcome:
    rebuilt: bool
    reason: str
    notes: list[str] = field(default_factory=list)
    index: store.Index | None = None


class Engine:
    """The indexer: one index of some roots, on file systems this driver can list."""

    def __init__(self, spark: SparkSession, path: str, notice: Callable[[str], None] = lambda _: None):
        self.spark, self.path, self.notice = spark, path, notice
        self._folder = SharedFolder(spark, path)

    def stored_roots(self) -> list[Root]:
        if not store.exists(self.spark, self.path):
            return []
        return [Root(r.path, r.source) for r in store.open_index(self.spark, self.path).roots().collect()]

    def list_roots(self) -> DataFrame:
        return store.open_index(self.spark, self.path).roots()

    def reset(self) -> None:
        with turns.exclusive(self.path, self.notice):
            store.reset_index(self.spark, self.path)

    def refresh(self, add: list[str] | None = None, remove: list[str] | None = None, local: str | None = None, source: str | None = None, if_changed: bool = False) -> Outcome:
        """Build the index of the planned roots anew; with ``if_changed``, only if its stamp
        doesn't match what is there now."""
        os.makedirs(self.path, exist_ok=True)
        with turns.exclusive(self.path, self.notice):
            return self._refresh(add, remove, local, source, if_changed, False)

    def _refresh(self, add: list[str] | None, remove: list[str] | None, local: str | None, source: str | None, if_changed: bool, strict: bool) -> Outcome:
        stored = self.stored_roots()
        unknown = [r for r in stored if r.source not in SOURCES]
        if unknown and not source:
            raise ListingError(f"{unknown[0].path}: listed by {unknown[0].source!r}, which this version doesn't know")
        plan = plan_roots(stored, add, local, remove, source)
        if local and any(r.source == "git" for r in plan.roots):
            exclude_from_git(local, self.path)
        snap = snapshot(plan.roots, strict=strict)
        notes = plan.notes + snap.notes
        names = [r.path for r in plan.roots]
        had = stamp.read(self._folder)
        same_roots = [(r.path, r.source) for r in stored] == [(r.path, r.source) for r in plan.roots]
        if if_changed and same_roots:
            reason = stamp.stale_because(had, snap, self._bytes())
            if reason is None:
                stamp.refresh_heads(self._folder, had, names)
                return Outcome(False, "current", notes, store.open_index(self.spark, self.path))
        else:
            reason = "asked for" if not if_changed else "the roots changed"
        store.drop_abandoned(self.spark, self.path)
        roots = self.spark.createDataFrame([(i, r.path, r.source) for i, r in enumerate(plan.roots)], store.TABLES["roots"])
        built = store.build_index(self.spark, self.path, snap.to_df(self.spark), roots, too_large=snap.too_large)
        stamp.write(self._folder, stamp.Stamp(snap.fingerprint, snap.taken_ns, built.stats.index_bytes, stamp.heads_of(names)))
        return Outcome(True, reason, notes, built)

    def _bytes(self) -> int | None:
        if not store.exists(self.spark, self.path):
            return None
        return self._folder.size(store.open_index(self.spark, self.path).meta["build"])

    def hook_refresh(self, cwd: str, after: tuple[str, list[str]] | None = None, give_up_s: float | None = None) -> str:
        """The refresh a hook asks for: nothing unless an index covers ``cwd`` and the command
        may have changed something; of a burst, one runs and one waits; never a walk instead
        of a list that failed. Returns what came of it."""
        if after and is_read_only(*after):
            return "read only"
        if not store.exists(self.spark, self.path):
            return "no index"
        here = os.path.realpath(cwd)
        if not any(is_within(here, r.path) for r in self.stored_roots()):
            return "not covered"
        with turns.turn(self.path, give_up_s, self.notice) as got:
            if got != turns.GO:
                return got
            return "rebuilt" if self._refresh(None, None, None, None, True, True).rebuilt else "current"

    def staleness(self) -> str | None:
        n = stamp.behind(stamp.read(self._folder))
        return f"the index is behind HEAD in {n} root{'s' * (n > 1)}; refresh it" if n else None
