"""What a Perforce workspace holds, as its command line tells in marshalled records."""

from __future__ import annotations

import os
import struct
import subprocess
from dataclasses import dataclass, field

#: Fixed value: errors of a lesser severity are remarks.
FAILED = 3


class PerforceError(RuntimeError):
    """Perforce gave no answer; the message is in its own words where it has any."""


@dataclass
class Record:
    texts: dict[str, bytes] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)

    def text(self, key: str) -> str | None:
        value = self.texts.get(key)
        return None if value is None else value.decode("utf-8", "replace")

    @property
    def code(self) -> str | None:
        return self.text("code")


def parse_records(raw: bytes) -> list[Record]:
    """Dictionaries ``{ (key value)* 0``: keys and texts are ``s``, a four-byte length and
    bytes; numbers are ``i`` and four bytes; all little-endian. Anything else is an error."""
    at = 0

    def take(n: int, what: str) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise PerforceError(f"the output ends within {what}")
        at += n
        return raw[at - n : at]

    def text() -> bytes:
        return take(struct.unpack("<I", take(4, "a length"))[0], "a text")

    out: list[Record] = []
    while at < len(raw):
        if take(1, "a record") != b"{":
            raise PerforceError(f"byte {raw[at - 1]:#04x} where record {len(out) + 1} should begin")
        record = Record()
        while (tag := take(1, "a record")) != b"0":
            if tag != b"s":
                raise PerforceError(f"byte {tag[0]:#04x} where a key should be")
            key = text().decode("utf-8", "replace")
            kind = take(1, "a record")
            if kind == b"s":
                record.texts[key] = text()
            elif kind == b"i":
                record.numbers[key] = struct.unpack("<i", take(4, "a number"))[0]
            else:
                raise PerforceError(f"byte {kind[0]:#04x} where the value of {key!r} should be")
        out.append(record)
    return out


def failure(records: list[Record]) -> str | None:
    """What the records say went wrong: the texts of all errors that are failures."""
    bad = [r for r in records if r.code == "error" and r.numbers.get("severity", FAILED) >= FAILED]
    said = " ".join(" ".join((r.text("data") or "").split()) for r in bad).strip()
    return said or None


def run(folder: str, *args: str, program: str = "p4") -> list[Record]:
    """The records of a command, run in and for ``folder``."""
    try:
        done = subprocess.run([program, "-G", "-d", folder, *args], cwd=folder, env=os.environ | {"PWD": folder}, stdin=subprocess.DEVNULL, capture_output=True, check=False)
    except OSError as e:
        raise PerforceError(f"p4 could not be run: {e}") from e
    plain = [x.strip() for x in (done.stderr + b"\n" + done.stdout).decode("utf-8", "replace").splitlines() if x.strip()]
    try:
        records = parse_records(done.stdout)
    except PerforceError:
        if done.returncode:
            raise PerforceError(plain[0] if plain else f"p4 {' '.join(args)} failed") from None
        raise
    said = failure(records)
    if said or done.returncode:
        raise PerforceError(said or (plain[0] if plain else f"p4 {' '.join(args)} failed"))
    return records


def workspace(folder: str, program: str = "p4") -> tuple[str, str | None]:
    """The client's name and its root as the client spells it (None: it has no single one)."""
    info = next((r for r in run(folder, "info", program=program) if r.code == "stat"), None)
    if info is None or info.text("clientName") is None:
        raise PerforceError("p4 info named no client")
    root = info.text("clientRoot")
    if root is None:
        raise PerforceError("the server has no workspace by the client name in use here; check P4CLIENT or the P4CONFIG file")
    return info.text("clientName") or "", None if root == "null" else root


def workspace_root(folder: str, program: str = "p4") -> str:
    name, root = workspace(folder, program)
    if root is None:
        raise PerforceError(f"workspace {name!r} has no single root; name the directory to index")
    real, here = os.path.realpath(root), os.path.realpath(folder)
    if not os.path.isdir(real):
        raise PerforceError(f"the root of workspace {name!r}, {root}, cannot be resolved")
    if tail(here, real) is None and here != real:
        raise PerforceError(f"workspace {name!r} is rooted at {real}, which does not contain {here}")
    return real


def tail(path: str, folder: str) -> str | None:
    """What follows ``folder`` in ``path``, if the path lies below it."""
    start = folder.rstrip("/") + "/"
    return path[len(start) :] or None if path.startswith(start) else None


def placed(printed: str, spelled: str | None, real: str | None, root: str) -> str | None:
    """Where a printed path lies under ``root``: the client's spelling of its root is
    exchanged for the real one first. None if it lies elsewhere."""
    if spelled and real and (rest := tail(printed, spelled)):
        printed = f"{real.rstrip('/')}/{rest}"
    rest = tail(printed, root)
    return rest and f"{root.rstrip('/')}/{rest}"


def files(root: str, program: str = "p4") -> list[str]:
    """The files under ``root`` that were synced, or are open, each once and sorted."""
    name, spelled = workspace(root, program)
    real = os.path.realpath(spelled) if spelled else None
    told = [r.text("path") for r in run(root, "have", program=program)]
    told += [r.text("clientFile") for r in run(root, "fstat", "-Ro", f"//{name}/...", program=program)]
    found = {placed(p, spelled, real, root) for p in told if p}
    return sorted(p for p in found if p)
