"""Source files nobody wrote by hand: generated, minified, third-party, or data kept as code.

Each file is lexed (comments, literals, words, marks) and, if its lines are long, written
anew in a canonical form, one statement to a line; then its own lines are held against that:

* minified: the canonical form breaks most of the file's lines, and each many times (extreme
  expansion);
* generated: nearly all lines lex to one or two long shapes, evenly indented, or to few
  shapes with a checksum every so often, as locked versions are listed (perfect
  uniformity); or the file says so in a comment at its head, or has a name that generators
  give;
* data: literals dominate, and next to no line holds a word outside them, so that a long
  string among code doesn't count;
* third party: by the folder it lies in, by a notice at its head, or as a copy, whole or
  altered, of a known library file (shingles of five words, containment of 0.8 or more).

A file that only mentions such things stays what it is: notices count only as comments
within the head (the first lines, and all before the first code), in forms that state
the fact and don't deny it.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.notices import may_say_so, says_generated
from tessera.runtime import spread

#: Extensions and language tags by comment style.
SLASH = "c h cc cpp hpp java js jsx ts tsx go rs css scss kt swift scala cs php json javascript typescript golang rust".split()
HASH = "py sh rb pl yaml yml toml lock sum r python bash shell ruby".split()
DASH = "sql lua hs".split()
PROSE = "md txt rst markdown text".split()

#: Folders and names of generated and third-party files, and lock files.
GENERATED_PLACE = re.compile(r"(^|/)(generated|__generated__|generated-sources|generated-src|gen|autogen)/|\.(generated|gen|g)\.\w+$|\.pb(-c|\.gw|\.validate)?\.\w+$|_pb2(_grpc)?\.py$|_(gen|generated)\.\w+$|(^|/)zz_generated[^/]*$|(^|/)mock_[^/]*_mock\.\w+$|(^|/)moc_[^/]*\.\w+$|\.(tab|yy)\.\w+$|\.designer\.\w+$")
LOCK_NAME = re.compile(r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|go\.sum|poetry\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|Podfile\.lock|uv\.lock|flake\.lock)$")
THIRD_PLACE = re.compile(r"(^|/)(vendor|vendored|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|Pods|Carthage|external|externals|deps|site-packages)/")
MINIFIED_NAME = re.compile(r"[.-](min|bundle)\.(js|css|mjs)$")

#: What notices say, and what denies them.
GENERATED_NOTICE = re.compile(r"code generated\b.*\bdo not edit|\bdo not edit\b\W*(re-?generate|by hand)|@generated\b|<auto-?generated\b|\b(automatically|auto-?) ?generated (by|from|with|file)\b|\bgenerated (source|file|code)\W+(edit|do not|don't)|(manual edits|changes|modifications) (are|will be) (overwritten|lost)|\bdo not (modify|edit) by hand", re.I)
THIRD_NOTICE = re.compile(r"\bvendored from\b|\bbundled copy of\b|\bthird[- ]party code\b|\bimported unmodified from\b|\bupstream: *\S+ +release\b|\bcopied (verbatim|unmodified) from\b", re.I)
DENIAL = re.compile(r"not generated|used to be|hand-?written|by hand since|no longer|not vendored|instead of the (vendored|generated)|replacement for", re.I)
COMMENT = re.compile(r"\s*(//|#(?!include|define|if|endif|pragma|\[|!\[)|--|/\*|\*|<!--|;;|%|>)")
_MARKS = re.compile(r"^[\s/*#<!;%>-]+|[\s*/>-]+$")
#: Block comments closed within their line, and what prose only cites.
_CLOSED = re.compile(r"(?:\s*/\*.*?\*/)+(?:\s*//.*)?")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")

_STRINGS = r'"""[\s\S]*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*`"
_LEXERS = {style: re.compile(rf"(?:{note})|({_STRINGS})") for style, note in (("slash", r"//[^\n]*|/\*[\s\S]*?\*/"), ("hash", r"#[^\n]*"), ("dash", r"--[^\n]*|/\*[\s\S]*?\*/"))}
_NUMBER = re.compile(r"(?<!\w)\d[\w.]*")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_ENDS = re.compile(r"([;{}])")
#: What stands for a comment.
_NOTE = "\x01"
#: Letters as one, digits as one, then words and numbers as one mark each, blanks dropped.
_CLASSES = str.maketrans({c: "w" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"} | {c: "0" for c in "0123456789"})
_RUNS, _ANY_RUNS = re.compile(r"(w)[w0]*|(0)[w0.]*"), re.compile(r"([^\W\d]\w*)|\d[\w.]*")
_BLANKS = str.maketrans("", "", " \t\r\f\v")
#: Words that begin imports, and lines of the preprocessor that tell nothing of layout; a #define does, with its remark.
_IMPORTS = frozenset("import use from package include using require mod extern".split())
_CONDITIONS = re.compile(r"\s*#\s*(include|import|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|pragma|undef|error|warning|line)\b")
_FIRST = re.compile(r"\s*(\w+)")
#: Checksums, and what texts with any contain, as lists of locked versions carry them.
_DIGEST = re.compile(r"\b(?:sha\d{1,3}[-:=]|h1:)[\w+/=-]{20,}|\b[0-9a-f]{40,128}\b")
_DIGEST_NAMES = "sha1 sha2 sha3 sha5 h1: checksum".split()
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Texts with fewer characters than this, blanks aside, are nobody's case.
TINY = 40
_ENOUGH = re.compile(r"(?:\s*+\S){%d}" % TINY)
HEAD_LINES = 20
EXPANSION = 8.0
KEPT = 0.5
DENSE = 120
#: Characters, marks and words, of a line in the canonical form.
WIDTH = 100
UNIFORM_LINES = 5
UNIFORM_SHAPE = 8
LOCKED, LOCK_SHAPES = 3, 8
LITERAL_SHARE = 0.7
SHINGLE = 5
CONTAINED = 0.8
#: Characters whose words are hashed together.
STRETCH = 1 << 19
_BLANK_RUN = re.compile(r"\s")
LEAST_SHINGLES = 20
#: Known library texts up to this many bytes are looked up in each task; beyond, they are joined.
KNOWN_BYTES = 64 << 20


def style_of(path: str | None, lang: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    for tag in (ext, (lang or "").strip().lower()):
        for style, tags in (("slash", SLASH), ("hash", HASH), ("dash", DASH), ("prose", PROSE)):
            if tag in tags:
                return style
    return "slash"


def _stripped(text: str, style: str) -> tuple[str, int, int]:
    """The text with each comment and string as one mark; how many strings there are, and
    their characters."""
    sizes: list[int] = []

    def mark(m: re.Match) -> str:
        if m[1] is None:
            return _NOTE
        sizes.append(len(m[1]))
        return '"'

    return _LEXERS[style].sub(mark, text), len(sizes), sum(sizes)


def _shown(plain: str) -> str:
    """``plain`` with each word and number as one mark, and no blanks but line ends."""
    if plain.isascii():
        return _RUNS.sub(r"\1\2", plain.translate(_CLASSES)).translate(_BLANKS)
    marked = _ANY_RUNS.sub(lambda m: "w" if m[1] else "0", plain)
    return "\n".join("".join(x.split()) for x in marked.split("\n"))


def _broken(line: str, style: str) -> Iterator[str]:
    """A long line's statements and parts: a break after each end of a statement and brace,
    after commas outside of parentheses (of joined statements, or members), and before a
    word that would pass ``WIDTH``."""
    open_at: list[str] = []
    made: list[str] = []
    width = 0
    for tok in _TOKEN.findall(line):
        word, number = tok[0].isalnum() or tok[0] == "_", tok[0].isdigit()
        if made and word and not number and width + len(tok) > WIDTH:
            yield " ".join(made)
            made, width = [], 0
        made.append(tok)
        width += 0 if number or tok == '"' else len(tok) + word
        if tok in "([{":
            open_at.append(tok)
        elif tok in ")]}" and open_at:
            open_at.pop()
        if tok in ";{}" or tok == "," and style == "slash" and not (open_at and open_at[-1] in "(["):
            yield " ".join(made)
            made, width = [], 0
    if made:
        yield " ".join(made)


def canonical(plain: str, style: str) -> list[list[str]]:
    """The canonical text of each code line of ``plain`` (``_stripped``), as the lines that it
    becomes: without comments, blanks put right, one statement or brace to a line, and none
    longer than ``WIDTH`` that can be broken."""
    out = []
    for line in plain.replace(_NOTE, " ").split("\n"):
        x = " ".join(line.split())
        if x:
            out.append(list(_broken(x, style)) if len(x) > WIDTH else [y for y in map(str.strip, _ENDS.sub("\\1\n", x).split("\n")) if y])
    return out


def _tells(line: str, shape: str) -> bool:
    """If a line tells something of layout: imports and conditions don't."""
    if len(shape) < 3:
        return False
    if shape[0] == "#":
        return not _CONDITIONS.match(line)
    return shape[0] != "w" or _FIRST.match(line.replace(_NOTE, " "))[1] not in _IMPORTS


def layout(text: str, style: str) -> dict[str, float]:
    """The file's layout, and what becomes of it in canonical form.

    ``lines`` of code, ``dense`` characters to each; where that is much, ``expansion``, the
    canonical lines to each, and the share ``kept`` as they were; the lines with words and,
    where these are few, the share of ``literal`` characters; and of the lines that tell
    something, their shapes (words, numbers and strings as one mark each): the shares of
    the two most frequent and of the first, its length, their number, and that of indents.
    """
    digests = 0
    if any(x in text for x in _DIGEST_NAMES):
        text, digests = _DIGEST.subn('"-"', text)
    plain, strings, chars = _stripped(text, style)
    every = _shown(plain).split("\n")
    at = [i for i, y in enumerate(every) if y.strip(_NOTE)]
    n_lines = len(at)
    code = len("".join(plain.split())) - plain.count(_NOTE) - strings + chars
    dense = code / max(1, n_lines)
    word_lines = sum("w" in every[i] for i in at)
    out = {"lines": n_lines, "dense": dense, "expansion": 1.0, "kept": 1.0, "literal": 0.0, "word_lines": word_lines, "digests": digests}
    if word_lines <= _few_words(n_lines):
        out["literal"] = (chars + sum(map(len, _NUMBER.findall(plain)))) / max(1, code)
    if dense >= DENSE:
        made = canonical(plain, style)
        out["expansion"] = sum(map(len, made)) / max(1, n_lines)
        out["kept"] = sum(len(m) == 1 for m in made) / max(1, n_lines)
    lines = plain.split("\n")
    bare = [(i, every[i].replace(_NOTE, "/**/" if every[i][0] == "#" else "")) for i in at]
    shapes = Counter(y for i, y in bare if _tells(lines[i], y))
    top = shapes.most_common(2)
    n = sum(shapes.values())
    uniform = sum(c for _, c in top) / n if n else 0.0
    indents = len({x[: len(x) - len(x.lstrip())] for x in (lines[i] for i in at)}) if uniform >= 0.9 else 0
    return out | {"shaped": n, "uniform": uniform, "first": top[0][1] / n if n else 0.0, "shape": len(top[0][0]) if top else 0, "shapes": len(shapes), "indents": indents}


def _few_words(lines: int) -> int:
    return max(4, lines // 10)


def _head_comments(text: str) -> Iterator[str]:
    """The comments in the first lines, and all before the first code, however long."""
    inside = block = code = False
    at = n = 0
    while at <= len(text) and (n < HEAD_LINES or not code):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, at, n = text[at:end], end + 1, n + 1
        note = COMMENT.match(line)
        if note or (inside if n <= HEAD_LINES else block):
            own = _CLOSED.match(line) if note else re.match(r".*?\*/", line)
            yield own[0] if own else line
        code = code or not (note or block or not line.strip() or line.startswith(("#!", "<?")))
        opens = "/*" in line and "*/" not in line
        inside = (inside or opens) and "*/" not in line
        block = (block or opens and line.lstrip().startswith("/*")) and "*/" not in line


def _head_prose(text: str) -> Iterator[str]:
    """The first line, then titles, quotes and remarks up to the first paragraph, and all
    of that; what stands in quotation marks is only mentioned."""
    begun = remark = False
    for n, line in enumerate(io.StringIO(text)):
        x = line.strip()
        if begun and not x:
            return
        remark = remark or x.startswith("<!--")
        begun = begun or bool(x) and not remark and not x.startswith(("#", ">", "===", "---"))
        remark = remark and "-->" not in x
        yield _QUOTED.sub("", x) if n else x


def _head(text: str, style: str) -> list[str]:
    return list(_head_prose(text) if style == "prose" else _head_comments(text))


def _stated(head: list[str], notice: re.Pattern) -> bool:
    return any(notice.search(x) and not DENIAL.search(x) for x in head)


def _states_generated(head: list[str]) -> bool:
    """In the fixed forms, or in others that say so in one head comment or two on end."""
    if _stated(head, GENERATED_NOTICE):
        return True
    if not may_say_so("\n".join(head)):
        return False
    lines = [_MARKS.sub("", x).strip() for x in head]
    pairs = (f"{a} {b}" for a, b in zip(lines, lines[1:]))
    return any(says_generated(x) and not DENIAL.search(x) for x in (*lines, *pairs))


def kinds_of(text: str | None, path: str | None, lang: str | None) -> set[str]:
    """The kinds that the file itself shows; copies of known texts are found elsewhere."""
    if not text or not _ENOUGH.match(text):
        return set()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    path = path or ""
    style = style_of(path, lang)
    head = _head(text, style)
    out = set()
    if LOCK_NAME.search(path) or GENERATED_PLACE.search(path) or _states_generated(head):
        out.add("generated")
    if THIRD_PLACE.search(path) or _stated(head, THIRD_NOTICE):
        out.add("third_party")
    if style == "prose":
        return out
    x = layout(text, style)
    if x["literal"] >= LITERAL_SHARE and x["word_lines"] <= _few_words(x["lines"]) and x["lines"] > 0:
        out.add("data")
    elif x["expansion"] >= EXPANSION and x["kept"] < KEPT and x["dense"] >= DENSE or MINIFIED_NAME.search(path) and x["dense"] >= DENSE:
        out.add("minified")
    elif x["shaped"] >= UNIFORM_LINES and x["uniform"] >= 0.97 and x["first"] >= 0.5 and x["shape"] >= UNIFORM_SHAPE and x["indents"] <= 2 and not path.endswith((".yaml", ".yml", ".sh")):
        out.add("generated")
    elif x["digests"] >= LOCKED and x["digests"] * 8 >= x["lines"] and x["shapes"] <= LOCK_SHAPES and x["lines"] >= UNIFORM_LINES:
        out.add("generated")
    return out


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Of each code point: 1 for a part of a word, 2 for a mark, 0 for a blank."""
    if not _KINDS:
        every = "".join(map(chr, range(0x110000)))
        kind = np.full(0x110000, 2, np.uint8)
        for pattern, k in ((r"\w+", 1), (r"\s+", 0)):
            for m in re.finditer(pattern, every):
                kind[m.start() : m.end()] = k
        _KINDS.append(kind)
    return _KINDS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash; words are runs of letters and digits, or
    single marks. A character counts with its place in the word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    word = kind == 1
    begins = kind == 2
    begins[1:] |= word[1:] & ~word[:-1]
    begins[:1] |= word[:1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    held = np.flatnonzero(kind)
    place = held - starts[np.cumsum(begins)[held] - 1]
    terms = _mixed((points[held].astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(21))) * _MIX)
    return starts, _mixed(np.add.reduceat(terms, np.flatnonzero(begins[held])))


def _stretches(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts put together to about ``STRETCH`` characters, with where each begins and its
    number. A longer text comes in parts that have ``SHINGLE`` - 1 words in common, so that
    each shingle lies whole in one."""
    parts: list[str] = []
    begins: list[int] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end, again = at, at
            while end < len(text) and again == at:  # on to the end of a word, back by some words
                blank = _BLANK_RUN.search(text, end + STRETCH)
                end = blank.end() if blank else len(text)
                again = at + int((_words(text[at:end])[0][1 - SHINGLE :].tolist() or [0])[0]) if end < len(text) else end
            piece = text[at:end]
            if size and size + len(piece) > STRETCH:
                yield "\n".join(parts), np.array(begins), np.array(owner)
                parts, begins, owner, size = [], [], [], 0
            parts.append(piece)
            begins.append(size)
            owner.append(i)
            size += len(piece) + 1
            at = again
    if parts:
        yield "\n".join(parts), np.array(begins), np.array(owner)


def _shingled(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers): every five words in a row, in order."""
    for joined, begins, owner in _stretches(texts):
        starts, x = _words(joined)
        n = len(x) - SHINGLE + 1
        if n <= 0:
            continue
        whose = np.searchsorted(begins, starts, side="right") - 1
        made = x[:n]
        for i in range(1, SHINGLE):
            made = (made ^ made >> np.uint64(29)) * _MIX + x[i : n + i]
        whole = whose[:n] == whose[SHINGLE - 1 :]
        yield made[whole].view(np.int64), owner[whose[:n][whole]]


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of every five words in a row; a text of fewer has none."""
    return np.unique(np.concatenate([h for h, _ in _shingled([text])] or [np.zeros(0, np.int64)]))


class KnownTexts:
    """Which known texts hold a shingle: sorted hashes with their owners."""

    def __init__(self, items: list[tuple[int, str | None]]):
        each = [shingles(t) for _, t in items]
        self.sizes = np.array([len(x) for x in each], np.int64)
        every, owner = np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.arange(len(each)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]

        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & ((1 << 20) - 1)] = True

    def holds_copy(self, own: np.ndarray) -> bool:
        """If the distinct shingles ``own`` make a copy of any known text."""
        lo, hi = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, side="right")
        n = hi - lo
        if not n.any():
            return False
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        least = np.minimum(self.sizes, len(own))
        return bool(((shared >= CONTAINED * least) & (least >= LEAST_SHINGLES)).any())

    def copies(self, texts: list[str | None]) -> set[int]:
        """The numbers of those ``texts`` that are copies. Only a text with a known shingle
        is looked at by itself."""
        parts = list(_shingled(texts))
        near: set[int] = set()
        for hashes, owner in parts:
            maybe = np.flatnonzero(self.seen[hashes & ((1 << 20) - 1)])
            at = np.searchsorted(self.hashes, hashes[maybe])
            held = at < len(self.hashes)
            held[held] = self.hashes[at[held]] == hashes[maybe[held]]
            near.update(np.unique(owner[maybe[held]]).tolist())
        own: dict[int, list[np.ndarray]] = {i: [] for i in near}
        for hashes, owner in parts:
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for i, piece in zip(owner[np.concatenate(([0], cuts))].tolist() if len(owner) else [], np.split(hashes, cuts)):
                if i in near:
                    own[i].append(piece)
        return {i for i, x in own.items() if self.holds_copy(np.unique(np.concatenate(x)))}


_FIELDS = ("generated", "minified", "third_party", "data")


def _judge(known: KnownTexts | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags: dict[str, list[bool]] = {f: [] for f in _FIELDS}
            texts, paths, langs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            copies = known.copies(texts) if known is not None else ()
            for i, (text, path, lang) in enumerate(zip(texts, paths, langs)):
                kinds = kinds_of(text, path, lang) | ({"third_party"} if i in copies else set())
                for f in _FIELDS:
                    flags[f].append(f in kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(flags[f], pa.bool_()) for f in _FIELDS)], names=["row", *_FIELDS])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [shingles(t) for t in batch.column(1).to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        at = np.repeat(np.arange(len(each)), n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([*each, np.zeros(0, np.int64)])), pa.array(n[at])], names=["key", "hash", "size"])


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def copies_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Digests of those texts of ``docs`` that copy a text of ``items``: the same test as
    ``KnownTexts`` where the known texts are too large for each task. Whether a text is a
    copy depends on the text alone, so each distinct one counts once, whatever its key."""
    def rows(df: DataFrame) -> DataFrame:
        schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("hash", T.LongType()), T.StructField("size", T.LongType())])
        texts = df.filter(F.col("text").isNotNull()).select(_digest().alias("key"), "text").dropDuplicates(["key"])
        return texts.mapInArrow(_shingle_rows, schema)

    own = rows(docs)
    known = rows(items).select(F.col("key").alias("item"), F.col("hash"), F.col("size").alias("known"))
    least = F.least("size", "known")
    pairs = own.join(known, "hash").groupBy("key", "item", "size", "known").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.filter((F.col("shared") >= CONTAINED * least) & (least >= LEAST_SHINGLES)).select(F.col("key").alias("digest")).distinct()


def source_kinds(df: DataFrame, items: DataFrame, key: str = "doc_id", known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """(key, generated, minified, third_party, data): one row per row of ``df``, all false
    for hand-written files. Null, empty and tiny texts are none of these, wherever they
    lie; a null path or language is one that says nothing.

    The known texts go to every task only if they have at most ``known_bytes``, which is
    checked first; otherwise they are joined by their shingles.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = size <= known_bytes
    known = KnownTexts([(r.item_id, r.text) for r in items.select("item_id", "text").collect()]) if small else None
    rows = spread(df.select(F.struct(F.col(key).alias("key"), (F.lit(None).cast("binary") if small else _digest()).alias("digest")).alias("row"), "text", "path", "lang"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(f, T.BooleanType()) for f in _FIELDS)])
    judged = rows.mapInArrow(_judge(known), schema).select("row.key", "row.digest", *_FIELDS)
    if not small:
        copies = copies_by_join(rows.select("text"), items).withColumn("copy", F.lit(True))
        judged = judged.join(copies, "digest", "left").withColumn("third_party", F.col("third_party") | F.coalesce("copy", F.lit(False)))
    judged = judged.select("key", *_FIELDS)
    return judged.withColumnRenamed("key", key)


def not_hand_written(df: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    return source_kinds(df, items, key).filter("generated OR minified OR third_party OR data").select(key)
