"""The commit a repository's HEAD names, read from its files without starting git."""

from __future__ import annotations

import re
from pathlib import Path

_HASH = re.compile(r"(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\Z")
_REF = re.compile(r"refs(?:/(?!\.{1,2}(?:/|\Z))[^/]+)+\Z")


def _text(path: Path) -> str | None:
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def _repository(start: Path) -> Path | None:
    dot = next((d / ".git" for d in (start, *start.parents) if (d / ".git").exists()), None)
    if dot is None or dot.is_dir():
        return dot
    first = ((_text(dot) or "").splitlines() or [""])[0]
    return dot.parent / first[len("gitdir:") :].strip() if first.startswith("gitdir:") else None


def head(root: str | Path) -> str | None:
    """None where ``root`` is in no work tree, or its files don't plainly say."""
    git = _repository(Path(root))
    said = (_text(git / "HEAD") or "").strip() if git else ""
    if not said.startswith("ref:"):
        return said if _HASH.match(said) else None
    name = said[len("ref:") :].strip()
    if not git or not _REF.match(name):
        return None
    shared = _text(git / "commondir")
    common = git / shared.strip() if shared is not None else git
    for place in (git, common):
        loose = _text(place / name)
        if loose is not None:
            return loose.strip() if _HASH.match(loose.strip()) else None
    packed = dict(reversed(line.split(" ", 1)) for line in (_text(common / "packed-refs") or "").splitlines() if " " in line)
    found = packed.get(name, "")
    return found if _HASH.match(found) else None
