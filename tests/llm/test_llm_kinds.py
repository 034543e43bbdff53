"""What is and what is not written by hand."""

import random
import re

import numpy as np
import pytest

from tessera.llm import kinds

RNG = random.Random(1)
NAMES = ["reader", "writer", "bucket", "engine", "queue", "timer", "ledger", "socket", "valley", "packet"]


def code(n=30, seed=0):
    rng = random.Random(seed)
    forms = ["    {a}.{b}({c}, {n});", "if ({a} > {b}.{c}) {{", "}}", "    // the {a} must wait for each {b}", "    return {a}({b});", "let {a} = {b} + {n};", "{a}[{n}] = {b} & {c};", "    while ({a} != {b}) {{ {a}++; }}"]
    return "\n".join(rng.choice(forms).format(a=rng.choice(NAMES), b=rng.choice(NAMES), c=rng.choice(NAMES), n=rng.randint(1, 999)) for _ in range(n)) + "\n"


def minified(n=200):
    return "".join(RNG.choice(["if(a&&!b.c){d=3^d}", "var v=j(33),w=\"x\";", "for(let i=0;i<u.length;i++)u[6]+=i;", "function q(t,k){return t.w(k[3])}"]) for _ in range(n))


CASES = [
    ("notice", "// Code generated by toolgen v1 from a.proto. DO NOT EDIT.\n" + code(), "src/a.js", {"generated"}),
    ("notice below a licence", "// Copyright (c) 2020 someone\n// Licensed as is\n//\n// AUTO-GENERATED FILE (routegen 1). Do not modify by hand!\n" + code(), "src/a.js", {"generated"}),
    ("notice in a block", "/*\n * @generated SignedSource<<abc>>\n */\n" + code(), "src/a.c", {"generated"}),
    ("place", code(), "/r/src/__generated__/a.ts", {"generated"}),
    ("name", code(), "/r/src/thing_pb2.py", {"generated"}),
    ("lock file", "version = 3\n\n" + '[[package]]\nname = "a"\nversion = "1.2.3"\n' * 9, "/r/Cargo.lock", {"generated"}),
    ("uniform", "\n".join(f'  {n}{i}: {{ id: {i}, wire: "{n}", repeated: false }},' for i, n in enumerate(NAMES)) + "\n", "src/a.js", {"generated"}),
    ("minified", minified(), "src/a.js", {"minified"}),
    ("numbers", "const t = [\n" + "\n".join(",".join(str(RNG.random())[:8] for _ in range(9)) + "," for _ in range(20)) + "\n];\n", "src/a.js", {"data"}),
    ("one literal", 'export default "data:application/octet-stream;base64,' + "Ab3/" * 400 + '";\n', "src/a.js", {"data"}),
    ("rows", "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, 'name{i}', {i}.5)" for i in range(40)) + ";\n", "a.sql", {"data"}),
    ("third-party place", code(), "/r/vendor/lib/a.go", {"third_party"}),
    ("third-party notice", "// Vendored from somelib 1.2.3, local changes: none\n" + code(), "src/a.go", {"third_party"}),
    ("third-party bundle", "# This is a bundled copy of somelib 1.2.3\n" + "x = reader(1)\nfor y in x:\n    print(y, 'a')\n" * 6, "src/a.py", {"third_party"}),
    ("plain code", code(), "src/a.js", set()),
    ("emits a notice", code(20) + 'emit(`// AUTO-GENERATED FILE (x). Do not modify by hand!`);\n' + code(20, 1), "src/emit.js", set()),
    ("speaks of generation", "// Hand-written replacement for the generated reader stubs.\n" + code(), "src/a.js", set()),
    ("denies it", "// This file is not generated; edit it freely.\n" + code(), "src/a.js", set()),
    ("once was", "// Used to be auto-generated by toolgen, maintained by hand since 2023.\n" + code(), "src/a.js", set()),
    ("do not edit something", "// DO NOT EDIT reader without telling writer: it waits\n" + code(), "src/a.js", set()),
    ("a long line", code() + 'let blob = "' + "ab12" * 600 + '";\n' + code(20, 2), "src/a.js", set()),
    ("some data", code(25) + "const t = [\n" + "1, 2, 3, 4, 5, 6, 7,\n" * 6 + "];\n" + code(20, 3), "src/a.js", set()),
    ("a name that sounds so", code(), "/r/vendor_portal/minify_pb2_reader.js", set()),
    ("prose", "Word after word without any code. " * 20, "notes.txt", set()),
    ("tiny", "x = 1\n", "/r/vendor/a.py", set()),
    ("empty", "", "/r/vendor/a.min.js", set()),
    ("null", None, "/r/vendor/a.min.js", set()),
    ("blanks", " \n" * 300, "/r/vendor/a.py", set()),
]


@pytest.mark.parametrize("name,text,path,want", CASES, ids=[c[0] for c in CASES])
def test_kinds(name, text, path, want):
    assert kinds.kinds_of(text, path, None) == want
    if text:
        assert kinds.kinds_of(text.replace("\n", "\r\n"), path, None) == want


def test_defines_show_uniform_layout():
    macros = "\n".join(f"#define {a.upper()}_{b.upper()} (0x{i:06x}) /* {a}{b} */" for i, (a, b) in enumerate(zip(NAMES, NAMES[3:]))) + "\n"
    assert kinds.kinds_of(macros, "src/a.c", "c") == {"generated"}
    assert kinds.kinds_of("#ifndef A_H\n#define A_H\n#include <b.h>\n" + macros * 4 + "#endif\n", "src/a.h", "c") == {"generated"}
    assert kinds.kinds_of("".join(f"#define {n.upper()} {i}\n" for i, n in enumerate(NAMES)), "src/a.h", "c") == set()
    assert kinds.kinds_of("".join(f"#include <{n}/{n}.h> /* {n} */\n" for n in NAMES) + "#ifdef A\n" + code(), "src/a.c", "c") == set()


LICENCE = "".join(f"// line {i} of a long licence that grants this and that to whoever may hold a copy of the software, as it is\n" for i in range(150))
NOTICE = "Code generated by toolgen v1 from a.proto. DO NOT EDIT."


def test_heads_of_any_length():
    assert kinds.kinds_of(LICENCE + f"// {NOTICE}\n" + code(), "src/a.js", None) == {"generated"}
    assert kinds.kinds_of("/*\n" + LICENCE.replace("//", " *") + " */\n\n// Vendored from somelib 1.2\n" + code(), "src/a.js", None) == {"third_party"}
    assert kinds.kinds_of("#!/bin/sh\n" + LICENCE.replace("//", "#") + f"# {NOTICE}\n" + "x=reader\n" * 9, "src/a.sh", None) == {"generated"}
    assert kinds.kinds_of(LICENCE + code(30) + f"// {NOTICE}\n" + code(), "src/a.js", None) == set()
    assert kinds.kinds_of("# see lib/*\n" + "x = reader(1)\n" * 30 + f"emit('{NOTICE}')\n", "src/a.py", None) == set()
    assert kinds.kinds_of(f"/* mine */ emit('{NOTICE}');\n" + code(), "src/a.js", None) == set()


def test_heads_of_prose():
    words = "Word after word without any code. " * 9
    assert kinds.kinds_of(f"# Title\n{NOTICE}\n\n{words}", "a.md", None) == {"generated"}
    assert kinds.kinds_of(f"# Title\n\n<!--\n{NOTICE}\n-->\n{words}", "a.md", None) == {"generated"}
    assert kinds.kinds_of(f"# Title\n{words}\n\nOthers say:\n{NOTICE}\n", "a.md", None) == set()
    assert kinds.kinds_of(f"# Title\nFiles that begin with `{NOTICE}` are left alone.\n{words}", "a.md", None) == set()


def test_a_blank_head_is_not_tiny():
    assert kinds.kinds_of(" " * 3000 + "\n" + code(), "/r/vendor/a.js", None) == {"third_party"}
    assert kinds.kinds_of(" " * 100_000 + "x = 1\n", "/r/vendor/a.js", None) == set()


def test_minified_without_semicolons_and_braces():
    commas = ",".join(f"{a[0]}{i}={b[0]}.{a[1]}({b[1]},{i})||!{a[2]}" for i, (a, b) in enumerate(zip(NAMES * 9, NAMES[3:] * 9)))
    assert kinds.kinds_of(f"var {commas}\n", "src/a.js", None) == {"minified"}
    joined = " if ".join(f"{a}({b}.{a} and not {b})" for a, b in zip(NAMES * 9, NAMES[3:] * 9))
    assert kinds.kinds_of(f"x = {joined}\n", "src/a.py", None) == {"minified"}
    call = "    return reader(bucket, engine, queue, timer, ledger, socket, valley, packet, writer, reader + 1, bucket * engine, queue)\n"
    assert kinds.kinds_of(code(6) + call * 3 + code(6, 1), "src/a.js", None) == set()
    wide = "SELECT " + ", ".join(f"{a}.{b}" for a, b in zip(NAMES * 2, NAMES[3:] * 2)) + " FROM reader\n"
    assert kinds.kinds_of(wide * 3, "a.sql", None) == set()


def test_minified_with_its_licence_kept():
    assert kinds.kinds_of("/*! lib v1.2 */\n" + minified(), "src/app.min.js", "javascript") == {"minified"}


def test_languages_where_no_path_tells():
    assert kinds.style_of(None, "Python") == "hash" and kinds.style_of("a.sql", None) == "dash" and kinds.style_of(None, None) == "slash" and kinds.style_of("README.md", "go") == "prose"


def altered(text, every):
    lines = text.splitlines()
    return "\n".join("changed(1);" if i % every == every - 1 else x for i, x in enumerate(lines))


def test_copies(spark):
    known = {1: code(80, 11), 2: code(60, 12), 3: "tiny text", 4: None}
    docs = {10: known[1], 11: altered(known[1], 40), 12: "// mine\n" + known[2] + "\n// more\n", 13: code(80, 99), 14: altered(known[1], 2), 15: None, 16: "tiny text", 17: known[1][: len(known[1]) // 2]}
    df = spark.createDataFrame([(k, t, "src/a.js", None, "extra") for k, t in docs.items()] + [(None, known[1], None, "JS", "x")], "doc_id long, text string, path string, lang string, key string")
    items = spark.createDataFrame([(k, t, "p") for k, t in known.items()], "item_id long, text string, path string")
    want = {10, 11, 12, 17, None}
    for limit in (kinds.KNOWN_BYTES, 0):
        rows = kinds.source_kinds(df, items, known_bytes=limit).collect()
        if limit == 0:
            assert {r.doc_id for r in rows if r.third_party} | {None} == want
        else:
            assert {r.doc_id for r in rows if r.third_party} == want
        assert len(rows) == 9
    assert {r.doc_id for r in kinds.not_hand_written(df, items).collect()} == want
    assert kinds.source_kinds(df.filter("false"), items).count() == 0
    assert {r.doc_id for r in kinds.source_kinds(df, items.filter("false")).filter("third_party").collect()} == set()


def test_copies_with_null_and_repeated_keys(spark):
    known = code(80, 11)
    half = altered(known, 2)  # too far from it, unless shingles count twice
    docs = [(None, known), (None, half), (1, known), (2, half), (2, half), (3, known), (3, code(80, 99)), (None, None), (4, "")]
    df = spark.createDataFrame([(k, t, "src/a.js", None) for k, t in docs], "doc_id long, text string, path string, lang string")
    items = spark.createDataFrame([(7, known, "p"), (7, known, "q"), (None, known, "r"), (None, None, "s")], "item_id long, text string, path string")
    told = []
    for limit in (kinds.KNOWN_BYTES, 0):
        rows = kinds.source_kinds(df, items, known_bytes=limit).collect()
        told.append(sorted(((r.doc_id or 0), r.third_party) for r in rows))
    assert told[0] == told[1] == sorted([(0, True), (0, False), (1, True), (2, False), (2, False), (3, True), (3, False), (0, False), (4, False)])


def test_canonical_form():
    plain, strings, chars = kinds._stripped('a = "x;y"; // note; note\nif (b) { c(1, 2); } /* d\n; */', "slash")
    assert (strings, chars) == (1, 5) and plain.count("\n") == 1
    assert kinds.canonical(plain, "slash") == [['a = ";'], ["if (b) {", "c(1, 2);", "}"]]
    long = "var " + ",".join(f"name{i}=call(a,b)" for i in range(20)) + ";"
    made = kinds.canonical(long, "slash")
    assert len(made) == 1 and len(made[0]) == 20 and made[0][1] == "name1 = call ( a , b ) ,"
    assert "".join(made[0]).replace(" ", "") == long.replace(" ", "")  # nothing is lost
    words = kinds.canonical(" ".join(["word"] * 100), "hash")[0]
    assert max(map(len, words)) <= kinds.WIDTH and len(words) == 5


def test_shown_forms_agree():
    for text in ("x1 = 0xac2a + 1.5e3; é2 = y_3", "for i in range(10):\n\tprint(i, 2)", "", "1a b_2.c 3"):
        ascii_only = kinds._shown(text.replace("é", "e"))
        assert kinds._shown(text + "\u00e9") == kinds._shown(text.replace("é", "e") + "e") and " " not in ascii_only
    assert kinds._shown("x1 = 0xac2a + 1.5e3") == "w=0+0"


def test_layout_alone_finds_locked_versions_and_leading_blanks_hide_nothing():
    lock = "version = 3\n\n" + "".join(f'[[package]]\nname = "p{i}"\nversion = "1.{i}.0"\nchecksum = "{"0123456789abcdef" * 4}"\n\n' for i in range(6))
    assert kinds.kinds_of(lock, "deps.toml", None) == {"generated"}
    same = "".join(f"entries.push(new Entry({i}, names[{i}], 0x{i:04x}));\n" for i in range(40))
    assert kinds.kinds_of(same, "a.js", "js") == {"generated"} == kinds.kinds_of(" " * 3000 + "\n" * 3000 + same, "a.js", "js")
    notice = "// Code generated by x. DO NOT EDIT.\n" + "\n".join(f"f{i}(a, {'b' * i});" for i in range(9))
    assert kinds.kinds_of("\n" * 4000 + notice, "a.go", "go") == {"generated"}


def test_shingles_of_parts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["alpha ", "b1 ", "(", ") ", "\n", "é", "長い", "_x9 ", "longword" * 9 + " "]) for _ in range(3000))
    def brute(t):
        words = re.findall(r"\w+|[^\w\s]", t)
        return len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    whole = kinds.shingles(text)
    assert len(whole) == brute(text) and len(kinds.shingles("a b c d")) == 0 == len(kinds.shingles(None))
    for size in (1, 7, 300):
        monkeypatch.setattr(kinds, "STRETCH", size)
        assert np.array_equal(kinds.shingles(text), whole) and len(kinds.shingles("x" * 5000)) == 0
        texts = [text[:900], None, "", "a b", text[900:2000], "y" * 999, text]
        got = {i: set() for i in range(len(texts))}
        for hashes, owner in kinds._shingled(texts):
            for i in np.unique(owner).tolist():
                got[i] |= set(hashes[owner == i].tolist())
        assert all(got[i] == set(kinds.shingles(t).tolist()) for i, t in enumerate(texts))
