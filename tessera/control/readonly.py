"""Which commands of a version-control tool are known to leave the work tree as it was."""

from __future__ import annotations

#: The commands that only report, and the global options of the command line.
REPORTS = (
    "annotate", "branches", "changelists", "changes", "clients", "counters", "depots", "describe", "diff", "diff2", "dirs", "filelog", "files",
    "fixes", "fstat", "grep", "groups", "have", "help", "ignores", "info", "interchanges", "jobs", "labels", "login", "logout", "opened", "ping",
    "protects", "reviews", "sizes", "status", "streams", "tickets", "users", "where", "workspaces",
)
VALUED, PLAIN, PRINTS = set("bcCdHLpPQruvxz"), set("eGIqRs"), set("Vh?")


def command(words: list[str]) -> str | None:
    """The command among a command line's words; empty if there is none; None if an option
    before it isn't understood."""
    left = list(words)
    while left:
        word = left.pop(0)
        if not word.startswith("-"):
            return word
        option, value = word[1:2], word[2:]
        if option in PRINTS and option and not value:
            return ""
        if option in VALUED and option:
            left = left if value else left[1:]
        elif not (option in PLAIN and option and not value):
            return None
    return ""


def is_read_only(tool: str, words: list[str]) -> bool:
    """Anything not known to be read-only is taken to have changed something."""
    if tool != "p4":
        return False
    found = command(words)
    return found is not None and (found == "" or found in REPORTS)
