"""Two commands over the engine: ``index`` and ``search``."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.control import hooks
from tessera.control.engine import INDEX_VARIABLE, Engine, local_root, resolve_index_path
from tessera.control.readonly import is_read_only
from tessera.operators import grep
from tessera.plans.hir import PatternError
from tessera.runtime import ship
from tessera.sources.index import Index, IndexFormatError, open_index
from tessera.sources.listing import ListingError

MATCHED, NO_MATCH, FAILED = 0, 1, 2


def _session(threads: int | None) -> SparkSession:
    spark = SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    ix = sub.add_parser("index", help="build or refresh an index")
    ix.add_argument("paths", nargs="*")
    ix.add_argument("--indexpath")
    ix.add_argument("--list", action="store_true")
    ix.add_argument("--reset", action="store_true")
    ix.add_argument("--remove", action="append", default=[])
    ix.add_argument("--local", action="store_true")
    how = ix.add_mutually_exclusive_group()
    for source in ("git", "walk", "p4"):
        how.add_argument(f"--{source}", dest="source", action="store_const", const=source)
    ix.add_argument("--if-changed", action="store_true")
    ix.add_argument("--hook", action="store_true")
    ix.add_argument("--after", nargs=argparse.REMAINDER)
    ix.add_argument("--background", action="store_true", help="with --hook: return at once")
    ix.add_argument("--install-hooks", action="store_true")
    ix.add_argument("--uninstall-hooks", action="store_true")
    ix.add_argument("--print-hook", metavar="TOOL")
    ix.add_argument("--shell", default=os.path.basename(os.environ.get("SHELL", "sh")))
    ix.add_argument("--verbose", action="store_true")
    ix.add_argument("-j", "--threads", type=int)
    se = sub.add_parser("search", help="search the indexed files", add_help=False)
    se.add_argument("--help", action="help")
    se.add_argument("regexp")
    se.add_argument("-c", "--count", action="store_true")
    se.add_argument("-f", "--file-regexp")
    se.add_argument("-h", "--no-names", action="store_true")
    se.add_argument("-i", "--ignore-case", action="store_true")
    se.add_argument("-l", "--list-files", action="store_true")
    se.add_argument("-n", "--line-numbers", action="store_true")
    se.add_argument("--brute", action="store_true")
    se.add_argument("--indexpath")
    se.add_argument("--verbose", action="store_true")
    se.add_argument("-j", "--threads", type=int)
    return top


def formatted(rows: DataFrame, mode: str, names: bool, numbers: bool) -> Iterator[str]:
    """Result rows as text, in order, streamed a partition at a time."""
    for r in rows.select(grep.rendered(mode, names, numbers).alias("line")).toLocalIterator(prefetchPartitions=True):
        yield r.line


def search(index: Index, args: argparse.Namespace, out=sys.stdout, err=sys.stderr) -> int:
    how = {"ignore_case": args.ignore_case, "brute": args.brute, "name": args.file_regexp}
    if args.verbose:
        plan = index.explain_search(args.regexp, args.ignore_case, args.file_regexp).first()
        print(f"query: {plan.query}\ncandidates: {plan.candidates} of {plan.files} files", file=err)
    mode = "files" if args.list_files else "counts" if args.count else "lines"
    rows = getattr(index, f"search_{mode}")(args.regexp, **how)
    shown = 0
    try:
        for line in formatted(rows, mode, not args.no_names, args.line_numbers):
            print(line, file=out)
            shown += 1
        out.flush()
    except BrokenPipeError:
        return MATCHED  # the reader has had enough
    lost = index.lost_files(index.found_files(args.regexp, args.ignore_case, args.brute, args.file_regexp)).first()
    if lost.missing:
        print(f"{lost.missing} file(s) of the index are gone; a refresh drops them", file=err)
    if lost.unreadable:
        print(f"{lost.unreadable} file(s) of the index denied reading", file=err)
    return MATCHED if shown else NO_MATCH


def _without_session(args: argparse.Namespace, words: list[str]) -> int | None:
    """What needs no Spark: hooks, their text, and handing a refresh to another process."""
    try:
        if args.print_hook:
            print(hooks.shell_hook(args.print_hook, args.shell), end="")
        elif args.install_hooks:
            for note in hooks.install(local_root(os.getcwd())):
                print(note, file=sys.stderr)
        elif args.uninstall_hooks:
            print(f"removed {hooks.uninstall(local_root(os.getcwd()))} hook(s)", file=sys.stderr)
        elif args.hook and args.background:
            if not (args.after and is_read_only(args.after[0], args.after[1:])):
                hooks.detach([w for i, w in enumerate(words) if w != "--background" or "--after" in words[:i]])
        else:
            return None
    except (ValueError, NotADirectoryError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return FAILED
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "index" and (code := _without_session(args, argv if argv is not None else sys.argv[1:])) is not None:
        return code
    path = resolve_index_path(args.indexpath, os.environ.get(INDEX_VARIABLE), os.getcwd(), os.path.expanduser("~"))
    spark = _session(args.threads)
    say = lambda text: print(text, file=sys.stderr)
    engine = Engine(spark, path, say)
    try:
        if args.command == "search":
            note = engine.staleness()
            if note:
                say(note)
            return search(open_index(spark, path), args)
        if args.reset:
            engine.reset()
        if args.list:
            for r in engine.list_roots().collect():
                print(f"{r.source}\t{r.path}" if args.verbose else r.path)
            return 0
        if args.hook:
            engine.hook_refresh(os.getcwd(), (args.after[0], args.after[1:]) if args.after else None)
            return 0
        local = local_root(os.getcwd(), args.source == "p4") if args.local else None
        done = engine.refresh(args.paths, args.remove, local, args.source, args.if_changed)
        for note in done.notes:
            say(note)
        s = done.index.stats
        say(f"{'indexed' if done.rebuilt else 'unchanged:'} {s.files_indexed} files, {s.distinct_trigrams} trigrams, {s.posting_entries} posting entries, {s.index_bytes} bytes")
    except (IndexFormatError, ListingError, PatternError, NotADirectoryError) as e:
        if args.command == "index" and args.hook:
            return 0
        say(f"Error: {e}")
        return FAILED
    return 0


if __name__ == "__main__":
    sys.exit(main())
