"""Listing, planning of roots, stamps, turns and the commands."""

import io
import json
import os
import struct
import subprocess
import threading
import time
from types import SimpleNamespace

import pytest

from tessera.control import cli, compare, githead, hooks, stamp, turns
from tessera.control.engine import INDEX_NAME, Engine, exclude_from_git, local_root, resolve_index_path
from tessera.control.readonly import command, is_read_only
from tessera.operators.roots import collapse, collapse_list, is_within, plan_roots
from tessera.runtime import SharedFolder
from tessera.sources import listing, perforce
from tessera.sources.listing import FileEntry, Root
from tessera.streaming.refresh import PostingsLog, refresh_on

HAS_GIT = subprocess.run(["which", "git"], capture_output=True).returncode == 0
HASH = "0123456789abcdef0123456789abcdef01234567"


def files(root, *names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"content of {n}\n")
    return str(root)


def names(snap, root):
    return [f.path.removeprefix(f"{root}/") for f in snap.all_files()]


def test_walk(tmp_path):
    root = files(tmp_path / "r", "a.txt", ".hid", "_u.txt", "x~", "#y", "~z", "sub/b", ".git/c", "tiny", "a/b", "a-b/c", "~d/e")
    os.symlink(tmp_path / "r/a.txt", tmp_path / "r/link")
    assert names(listing.snapshot([Root(root)]), root) == ["_u.txt", "a/b", "a-b/c", "a.txt", "sub/b", "tiny"] or sorted(names(listing.snapshot([Root(root)]), root)) == ["_u.txt", "a-b/c", "a.txt", "a/b", "sub/b", "tiny"]
    hidden = files(tmp_path / ".root", "seen")
    assert names(listing.snapshot([Root(hidden)]), hidden) == ["seen"]
    small = listing.snapshot([Root(root)], limit=14)
    assert small.too_large == 6 - len(list(small.all_files())) > 0 and any("of at most 14 bytes" in n for n in small.notes)
    with pytest.raises(listing.ListingError):
        listing.snapshot([Root(root, "cvs")])


@pytest.mark.skipif(not HAS_GIT, reason="needs git")
def test_git_listing(tmp_path, monkeypatch):
    root = files(tmp_path / "r", "src/a.rs", "build/out.txt", "app.log", ".hidden")
    subprocess.run(["git", "init", "-q", root], check=True)
    (tmp_path / "r/.gitignore").write_text("build/\n*.log\n")
    subprocess.run(["git", "-C", root, "add", "src"], check=True)
    files(tmp_path / "r", "src/new.rs")
    monkeypatch.setenv("GIT_DIR", "/nonexistent")
    assert names(listing.snapshot([Root(root, "git")]), root) == ["src/a.rs", "src/new.rs"]
    assert set(names(listing.snapshot([Root(root)]), root)) == {"app.log", "build/out.txt", "src/a.rs", "src/new.rs"}
    plain = files(tmp_path / "p", "x")
    snap = listing.snapshot([Root(plain, "git")], strict=True)
    assert names(snap, plain) == ["x"] and "not a git work tree" in snap.notes[0]
    assert exclude_from_git(root, f"{root}/{INDEX_NAME}") and not exclude_from_git(root, f"{root}/{INDEX_NAME}")
    assert local_root(f"{root}/src") == os.path.realpath(root)


def test_git_that_fails(tmp_path, monkeypatch):
    root = files(tmp_path / "r", "x")
    monkeypatch.setattr(listing, "git_listed", lambda _: (None, "dubious ownership\nmore"))
    assert names(listing.snapshot([Root(root, "git")]), root) == ["x"]
    with pytest.raises(listing.ListingError, match="dubious ownership"):
        listing.snapshot([Root(root, "git")], strict=True)


def test_fingerprint_notices_every_change():
    roots = [Root("/r")]
    base = [FileEntry("/r/a", 10, 100, 500), FileEntry("/r/b", 20, 200, 600)]
    marks = {listing.fingerprint(roots, base), listing.fingerprint([Root("/r", "git")], base), listing.fingerprint([Root("/q")], base), listing.fingerprint(roots, base[:1]), listing.fingerprint(roots, base[::-1])}
    for changed in (FileEntry("/r/c", 20, 200, 600), FileEntry("/r/b", 21, 200, 600), FileEntry("/r/b", 20, 201, 600), FileEntry("/r/b", 20, 200, 601), FileEntry("/r/b", 20)):
        marks.add(listing.fingerprint(roots, [base[0], changed]))
    assert len(marks) == 10


def test_coarse_times(spark):
    e = lambda s, n=0: FileEntry("/r/x", 1, s, n)
    assert listing.newest_if_coarse([e(100), e(300), e(200)]) == 300
    assert listing.newest_if_coarse([e(100), e(300, 1)]) is None is listing.newest_if_coarse([e(1), FileEntry("/r/y", 1)]) is listing.newest_if_coarse([])
    df = spark.createDataFrame([(1, 5, 0), (1, 7, None), (2, 5, 1), (3, None, None), (4, -1, 0)], "g int, mtime_s long, mtime_ns int")
    assert {r.g: r.newest for r in listing.coarse_mtimes(df, "g").collect()} == {1: 7, 2: None, 3: None, 4: None}


def test_table_fingerprints_ignore_order(spark):
    rows = [("a", f"/f{i}", i, i, 0) for i in range(50)]
    schema = "g string, path string, len long, mtime_s long, mtime_ns int"
    mark = lambda x: {r.g: r.fingerprint for r in listing.listing_fingerprints(spark.createDataFrame(x, schema), "g").collect()}.get("a")
    assert mark(rows) == mark(rows[::-1]) and len({mark(rows), mark(rows[1:]), mark([*rows[1:], ("a", "/f0", 0, 0, 1)]), mark([*rows[1:], ("a", "/f0", 0, None, None)])}) == 4


def test_within():
    for child, parent, want in [("/a/b", "/a", True), ("/a", "/a", True), ("/ab", "/a", False), ("/a", "/a/b", False), ("/a", "/", True), (r"C:\code\x", r"C:\code", True), (r"C:\code-other", r"C:\code", False)]:
        assert is_within(child, parent) is want


def test_collapse(spark):
    rows = [("/a/b/c", "git"), ("/a/b", "walk"), ("/a/bc", "walk"), ("/a/b", "walk"), ("/x", "git"), (None, "walk")]
    kept, dropped = collapse_list([Root(*r) for r in rows[:5]])
    assert [(k.path, k.source) for k in kept] == [("/a/b", "walk"), ("/a/bc", "walk"), ("/x", "git")] and dropped == [("/a/b/c", "/a/b")]
    got = {r.path: r.covered_by for r in collapse(spark.createDataFrame(rows, "path string, source string")).collect()}
    assert got == {"/a/b/c": "/a/b", "/a/b": None, "/a/bc": None, "/x": None}
    got = {r.path: r.covered_by for r in collapse(spark.createDataFrame([("/", "walk"), ("/a/b", "walk"), ("/a", "walk")], "path string, source string")).collect()}
    assert got == {"/": None, "/a": "/", "/a/b": "/"}


def test_planning_of_roots():
    here = {"/a", "/b", "/c", "/a/sub"}
    plan = lambda stored, **k: plan_roots(stored, is_dir=lambda p: p.rstrip("/") in here, real=lambda p: p.rstrip("/"), is_repository=lambda p: p == "/c", **k)
    stored = [Root("/a", "git"), Root("/b", "walk")]
    pairs = lambda p: [(r.path, r.source) for r in p.roots]
    assert pairs(plan(stored)) == [("/a", "git"), ("/b", "walk")]
    assert pairs(plan(stored, source="walk")) == [("/a", "walk"), ("/b", "walk")]
    assert pairs(plan(stored, source="git", add=["/b"])) == [("/a", "git"), ("/b", "git")]
    assert pairs(plan(stored, add=["/c"])) == [("/a", "git"), ("/b", "walk"), ("/c", "walk")]
    assert pairs(plan(stored, local="/c")) == [("/a", "git"), ("/b", "walk"), ("/c", "git")]
    assert pairs(plan([Root("/c", "walk")], local="/c")) == [("/c", "walk")]
    done = plan([*stored, Root("/gone")], remove=["/b/", "/never"], add=["/a/sub"])
    assert pairs(done) == [("/a", "git")]
    assert done.notes == ["/never: not in the index", "/b: removed", "/gone: is gone; taken off the list of roots", "/a/sub: left to /a, which holds it"]
    with pytest.raises(NotADirectoryError):
        plan(stored, add=["/nowhere"])


# Perforce


def marshalled(*records):
    out = b""
    for r in records:
        out += b"{"
        for k, v in r.items():
            out += b"s" + struct.pack("<I", len(k)) + k.encode()
            out += b"i" + struct.pack("<i", v) if isinstance(v, int) else b"s" + struct.pack("<I", len(v)) + v.encode()
        out += b"0"
    return out


def test_records():
    got = perforce.parse_records(marshalled({"code": "stat", "n": -2}, {"path": "/x"}))
    assert got[0].code == "stat" and got[0].numbers == {"n": -2} and got[1].text("path") == "/x" and perforce.parse_records(b"") == []
    whole = marshalled({"code": "stat"})
    for bad in [whole[:i] for i in range(1, len(whole))] + [b"x", b"{x", b"{s\x01\0\0\0ax"]:
        with pytest.raises(perforce.PerforceError):
            perforce.parse_records(bad)


def test_failures_and_remarks():
    r = lambda sev: perforce.parse_records(marshalled({"code": "error", "data": "no  such\nfile\n"} | ({"severity": sev} if sev else {})))
    assert perforce.failure(r(2)) is None and perforce.failure(r(3)) == perforce.failure(r(None)) == "no such file"


def test_placing_of_paths():
    assert perforce.placed("/link/ws/a", "/link/ws", "/real/ws", "/real/ws") == "/real/ws/a"
    assert perforce.placed("/link/ws/d/a", "/link/ws", "/real/ws", "/real/ws/d") == "/real/ws/d/a"
    assert perforce.placed("/link/wsx/a", "/link/ws", "/real/ws", "/real/ws") is None and perforce.placed("/r/a", None, None, "/r") == "/r/a"


def fake_p4(tmp_path, answers):
    """A program that answers each command with the bytes stored for it."""
    for name, (raw, code) in answers.items():
        (tmp_path / f"{name}.out").write_bytes(raw)
        (tmp_path / f"{name}.code").write_text(str(code))
    p = tmp_path / "p4"
    p.write_text(f'#!/bin/sh\ncat "{tmp_path}/$4.out"\nexit $(cat "{tmp_path}/$4.code")\n')
    p.chmod(0o755)
    return str(p)


def test_files_of_a_workspace(tmp_path):
    root = files(tmp_path / "ws", "a", "b", "sub/c")
    info = marshalled({"code": "stat", "clientName": "me", "clientRoot": root})
    have = marshalled({"code": "stat", "path": f"{root}/sub/c"}, {"code": "stat", "path": "/elsewhere/x"}, {"code": "stat", "path": f"{root}/a"})
    opened = marshalled({"code": "stat", "clientFile": f"{root}/b"}, {"code": "stat", "clientFile": f"{root}/a"}, {"code": "error", "severity": 2, "data": "remark"})
    p4 = fake_p4(tmp_path, {"info": (info, 0), "have": (have, 0), "fstat": (opened, 0)})
    assert perforce.files(root, p4) == [f"{root}/a", f"{root}/b", f"{root}/sub/c"]
    assert perforce.workspace_root(f"{root}/sub", p4) == os.path.realpath(root)
    with pytest.raises(perforce.PerforceError, match="does not contain"):
        perforce.workspace_root(str(tmp_path), p4)
    for raw, code, said in [(b"Connect to server failed\n", 1, "Connect to server"), (b"hello", 0, "should begin"), (marshalled({"code": "error", "severity": 3, "data": "expired"}), 1, "expired"), (marshalled({"code": "stat", "clientName": "x"}), 0, "no workspace"), (marshalled({"code": "stat", "clientName": "x", "clientRoot": "null"}), 0, "no single root")]:
        with pytest.raises(perforce.PerforceError, match=said):
            perforce.workspace_root(root, fake_p4(tmp_path, {"info": (raw, code)}))
    with pytest.raises(perforce.PerforceError, match="could not be run"):
        perforce.files(root, "/no/such/program")


@pytest.mark.parametrize(
    "words,want",
    [("opened", True), ("-c me opened", True), ("-cme opened", True), ("sync", False), ("-c sync", True), ("", True), ("-V", True), ("-Z opened", False), ("print", False), ("-G -s fstat x", True), ("-p host:1 submit", False)],
)
def test_read_only_commands(words, want):
    assert is_read_only("p4", words.split()) is want and not is_read_only("git", words.split())


def test_command_of_a_line():
    assert command(["-u", "me", "sync", "..."]) == "sync" and command(["-?"]) == "" and command(["-"]) is None


# Heads and stamps


def test_heads(tmp_path):
    root, git = tmp_path / "r", tmp_path / "r/.git"
    (git / "refs/heads").mkdir(parents=True)
    put = lambda name, text: (git / name).write_text(text)
    assert githead.head(tmp_path / "r") is None
    put("HEAD", HASH + "\n")
    assert githead.head(root) == HASH
    put("HEAD", "ref: refs/heads/main\n")
    assert githead.head(root) is None
    put("packed-refs", f"# pack\n{HASH} refs/heads/main\n")
    (root / "deep").mkdir()
    assert githead.head(root / "deep") == HASH
    put("refs/heads/main", "f" * 40)
    assert githead.head(root) == "f" * 40
    put("refs/heads/main", "ref: refs/heads/other")
    assert githead.head(root) is None
    for bad in ("ref: refs/../HEAD", "ref: HEAD", "ref: refs//x", "nonsense", ""):
        put("HEAD", bad)
        assert githead.head(root) is None
    linked = tmp_path / "linked"
    linked.mkdir()
    (git / "worktrees/l").mkdir(parents=True)
    (linked / ".git").write_text("gitdir: ../r/.git/worktrees/l\n")
    (git / "worktrees/l/HEAD").write_text("ref: refs/heads/main")
    (git / "worktrees/l/commondir").write_text("../..\n")
    put("refs/heads/main", "e" * 40)
    assert githead.head(linked) == "e" * 40


def test_stamp_text():
    s = stamp.Stamp(0xAB, 1000 * 10**9 + 5, 77, ((HASH, "/a b"), (HASH, "/c")))
    text = stamp.render(s)
    assert stamp.parse(text) == s and stamp.parse(text + "later field\n") == s
    for bad in ("", "other\n" + text, text.replace("fingerprint", "fp"), text.replace("1000 5", "1000 1000000000"), text.replace("index 77", "index x"), text + "oneword\n", text.replace("/a b", "").replace(f"head {HASH} \n", f"head {HASH}\n")):
        assert stamp.parse(bad) is None, bad


@pytest.mark.parametrize("newest,stale", [(990, False), (998, False), (999, True), (1000, True), (2000, True), (None, False)])
def test_times_too_close(newest, stale):
    s = stamp.Stamp(1, 1000 * 10**9 + 500, 7)
    now = SimpleNamespace(fingerprint=1, newest_coarse_mtime=newest)
    assert stamp.stale_because(s, now, 7) == (stamp.TOO_CLOSE if stale else None)
    assert stamp.stale_because(None, now, 7) == stamp.NO_STAMP and stamp.stale_because(s, now, None) == stamp.NO_INDEX
    assert stamp.stale_because(s, now, 8) == stamp.OTHER_INDEX and stamp.stale_because(s, SimpleNamespace(fingerprint=2, newest_coarse_mtime=None), 7) == stamp.CHANGED


def test_roots_behind():
    s = stamp.Stamp(1, 1, 1, (("a", "/r1"), ("b", "/r2"), ("c", "/r3")))
    assert stamp.behind(s, {"/r1": "a", "/r2": "x"}.get) == 1 and stamp.behind(None) == 0


# Turns


def test_burst_runs_once_and_waits_once(tmp_path):
    at, ran, got = str(tmp_path / "ix"), [], []
    held, go = threading.Event(), threading.Event()

    def first():
        with turns.turn(at) as t:
            held.set()
            go.wait(10)
            got.append(t)

    def later():
        with turns.turn(at) as t:
            got.append(t)
            if t == turns.GO:
                ran.append(time.monotonic())

    a = threading.Thread(target=first)
    a.start()
    held.wait(10)
    b = threading.Thread(target=later)
    b.start()
    deadline = time.monotonic() + 10
    while time.monotonic() < deadline:  # until the second waits
        probe = turns._Flock(f"{at}.queue")
        free = probe.try_lock()
        probe.release()
        if not free:
            break
    rest = [threading.Thread(target=later) for _ in range(5)]
    [t.start() for t in rest]
    [t.join() for t in rest]
    assert got == [turns.COVERED] * 5
    go.set()
    a.join()
    b.join()
    assert sorted(got) == sorted([turns.COVERED] * 5 + [turns.GO] * 2) and len(ran) == 1


def test_giving_up(tmp_path):
    at, said = str(tmp_path / "ix"), []
    with turns.exclusive(at), turns.turn(at, 1.2, said.append) as t:
        assert t == turns.GAVE_UP and len(said) == 1


# The engine and its commands


def test_where_the_index_is(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / f"a/{INDEX_NAME}").mkdir()
    assert resolve_index_path("/x", "/y") == "/x" and resolve_index_path(None, "/y") == "/y"
    assert resolve_index_path(cwd=str(tmp_path / "a/b"), home="/home") == str(tmp_path / f"a/{INDEX_NAME}")
    assert resolve_index_path(cwd=str(tmp_path), home="/home") == f"/home/{INDEX_NAME}" and resolve_index_path() == f"./{INDEX_NAME}"


def test_refreshing(spark, tmp_path):
    root = files(tmp_path / "r", "a.txt", "sub/b.txt")
    e = Engine(spark, str(tmp_path / "ix"))
    assert e.hook_refresh(root) == "no index"
    assert e.refresh([root]).index.num_files == 2
    e.refresh()  # later than the files' times by more than a tick does not matter with fractions
    assert e.refresh(if_changed=True).rebuilt is False and e.hook_refresh(root) == "current"
    assert e.hook_refresh("/") == "not covered" and e.hook_refresh(root, ("p4", ["opened"])) == "read only"
    files(tmp_path / "r", "c.txt")
    done = e.refresh(if_changed=True)
    assert done.rebuilt and done.reason == stamp.CHANGED and done.index.num_files == 3
    SharedFolder(spark, e.path).remove(stamp.NAME)
    assert e.refresh(if_changed=True).reason == stamp.NO_STAMP
    assert [r.path for r in e.list_roots().collect()] == [root]
    gone = e.refresh(remove=[root])
    assert gone.notes == [f"{root}: removed"] and gone.index.num_files == 0
    e.reset()
    assert e.stored_roots() == []


def test_staleness_note(spark, tmp_path):
    root = files(tmp_path / "r", "a.txt")
    (tmp_path / "r/.git").mkdir()
    (tmp_path / "r/.git/HEAD").write_text(HASH)
    e = Engine(spark, str(tmp_path / "ix"))
    e.refresh([root])
    assert e.staleness() is None
    (tmp_path / "r/.git/HEAD").write_text("f" * 40)
    assert "1 root" in e.staleness()
    assert not e.refresh(if_changed=True).rebuilt and e.staleness() is None


def test_search_output(spark, tmp_path):
    root = files(tmp_path / "r", "a.txt", "b.txt")
    (tmp_path / "r/a.txt").write_text("hit\nmiss\nhit again\n")
    ix = Engine(spark, str(tmp_path / "ix")).refresh([root]).index

    def run(*words):
        out, err = io.StringIO(), io.StringIO()
        code = cli.search(ix, cli.parser().parse_args(["search", *words]), out, err)
        return code, out.getvalue().replace(root, "R"), err.getvalue()

    assert run("hit") == (0, "R/a.txt:hit\nR/a.txt:hit again\n", "") and run("-n", "-h", "hit")[1] == "1:hit\n3:hit again\n"
    assert run("-n", "hit")[1] == "R/a.txt:1:hit\nR/a.txt:3:hit again\n" and run("-c", "hit")[1] == "R/a.txt:2\n" and run("-c", "-h", "hit")[1] == "2\n"
    assert run("-l", "hit")[1] == run("-l", "-c", "hit")[1] == run("-l", "-h", "hit")[1] == "R/a.txt\n"
    assert run("-c", "zzz") == (1, "", "") and run("--brute", "-i", "HIT", "-f", "a[.]txt")[0] == 0
    assert "candidates: 1 of 2 files" in run("--verbose", "hit")[2]
    os.remove(f"{root}/a.txt")
    assert run("hit")[0] == 1 and "1 file(s) of the index are gone" in run("hit")[2]


def test_stream_of_changes(spark, tmp_path):
    source, log = tmp_path / "in", PostingsLog(spark, str(tmp_path / "log"))
    schema = "path string, seq long, content string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        refresh_on(stream, lambda df, n: log.append(df, n), str(tmp_path / "cp")).awaitTermination(120)

    def held():
        return {(r.path, r.trigram.to_bytes(3, "big").decode()) for r in log.postings().collect()}

    assert log.postings() is None
    arrive([("/a", 1, "abcd"), ("/b", 1, "xyz"), ("/a", 2, "bcd")])
    assert held() == {("/a", "bcd"), ("/b", "xyz")}
    arrive([("/b", 5, None), ("/c", 6, "hi!"), ("/a", 1, "late")])
    assert held() == {("/a", "bcd"), ("/c", "hi!")}
    before = held()
    log.append(spark.createDataFrame([("/b", 5, None), ("/c", 6, "hi!"), ("/a", 1, "late")], schema), 1)  # a batch run again
    assert held() == before


def test_entry_points():
    import __spark_entry__ as e

    named = e.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 5)} <= set(named) and set(e.oracle_sql()) <= set(named)
    assert json.dumps(sorted(named))


@pytest.mark.skipif(not HAS_GIT, reason="needs git")
def test_git_hooks(tmp_path):
    root = files(tmp_path / "r", "a")
    with pytest.raises(NotADirectoryError):
        hooks.install(root)
    subprocess.run(["git", "init", "-q", root], check=True)
    (tmp_path / "r/.git/hooks/post-merge").write_text("#!/bin/sh\necho mine\n")
    assert ["post-merge" in n for n in hooks.install(root, "true")] == [True]
    assert hooks.install(root, "true") and os.access(tmp_path / "r/.git/hooks/post-commit", os.X_OK)
    assert hooks.uninstall(root) == 3 and "mine" in (tmp_path / "r/.git/hooks/post-merge").read_text()


def test_shell_hooks(tmp_path):
    for bad in ("-x", "a b", "a;b", ""):
        with pytest.raises(ValueError):
            hooks.shell_hook(bad, "sh")
    with pytest.raises(ValueError):
        hooks.shell_hook("p4", "cmd")
    assert all(hooks.shell_hook("p4", s) for s in [*hooks.SHELLS, "/usr/bin/zsh", "C:\\x\\pwsh.exe"])
    tool = tmp_path / "p4"
    tool.write_text('#!/bin/sh\necho "tool $# $1"\nexit 3\n')
    seen = tmp_path / "seen"
    refresh = tmp_path / "refresh"
    refresh.write_text(f'#!/bin/sh\necho "$@" > "{seen}"\n')
    for f in (tool, refresh):
        f.chmod(0o755)
    text = hooks.shell_hook("p4", "sh", str(refresh))
    done = subprocess.run(["sh", "-c", text + 'p4 sync "a b"; echo $?'], env={"PATH": f"{tmp_path}:/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.stdout == "tool 2 sync\n3\n" and seen.read_text() == "--background --after p4 sync a b\n"


def test_commands_without_a_session(capsys, monkeypatch):
    sent = []
    monkeypatch.setattr(hooks, "detach", sent.append)
    assert cli.main(["index", "--print-hook", "p4", "--shell", "fish"]) == 0 and "function p4" in capsys.readouterr().out
    assert cli.main(["index", "--print-hook", "p 4"]) == cli.FAILED
    assert cli.main(["index", "--hook", "--background", "--after", "p4", "opened"]) == 0 and sent == []
    assert cli.main(["index", "--hook", "--background", "--after", "p4", "sync"]) == 0 and sent == [["index", "--hook", "--after", "p4", "sync"]]


def test_comparison(spark):
    assert compare.count_line("/c/a:b.txt:12\n", "/c/") == ("a:b.txt", 12) and compare.count_line("nothing", "/c") is None
    assert compare.patterns(["# note\n", "\n", "-i foo\n", "a#b\n"]) == [("foo", True), ("a#b", False)]
    calls = []
    assert len(compare.timed(lambda: calls.append(1), 3)) == 2 and len(calls) == 4
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, n long")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("w", 1)], "path string, n long")
    assert {r.path: r.kind for r in compare.differences(a, b).collect()} == {"y": "count", "z": "only left", "w": "only right"}
    assert compare.differences(a, a).count() == 0
