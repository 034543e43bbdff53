"""Splitting text into the words of a byte-level BPE, a batch of texts at a time.

The public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+`` tiles a text,
and where its words begin depends on character classes only. So the beginnings are found
for a whole batch with array operations, and the words are then slices of the batch's
UTF-8 bytes: an Arrow array without a copy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Longest stretch of text classified at once; longer texts are cut where a word surely begins.
PIECE = 1 << 20

#: Characters that the installed ``regex`` knows and the public tokenizers, of an
#: earlier version of Unicode, do not (first-last, hexadecimal). To those they are marks.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de "
    "1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33fff 3d000-3fc3f"
)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1]) + 1
            table[lo:hi] = kind
    for span in LATER.split():
        first, _, last = span.partition("-")
        table[int(first, 16) : int(last or first, 16) + 1] = OTHER
    return table


def _word_starts(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where words begin, in text whose pieces each end in a character of class END."""
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, cls[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = END, cls[1:]
    blank = cp == 32
    blank[cls == END] = False
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    space = cls == SPACE
    starts = (cls != before) & ~(joined & ~space)
    starts |= space & (after != SPACE) & (after != END)
    starts |= cls == END
    for i in np.flatnonzero((cp == 39) & starts):
        one = int(cp[i + 1]) if cls[i + 1] == LETTER else 0
        two = int(cp[i + 2]) if one and cls[i + 2] == LETTER else 0
        if one in (115, 116, 109, 100):
            ends = i + 2
        elif (one, two) in ((114, 101), (118, 101), (108, 108)):
            ends = i + 3
        else:
            continue
        starts[i + 1] = False
        starts[ends] = True
    return starts


def _pieces(text: str) -> list[str]:
    """``text`` cut before single blanks between other characters, about every PIECE characters."""
    if len(text) <= PIECE:
        return [text]
    table, out, at = char_classes(), [], 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while cut != -1 and cut + 1 < len(text) and SPACE in (table[ord(text[cut - 1])], table[ord(text[cut + 1])]):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= len(text):
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _batch_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    joined = "\n".join(texts) + "\n"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    raw = joined.encode()
    if len(raw) == len(joined):
        cp = np.frombuffer(raw, np.uint8)
        width = None
    else:
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        width = 1 + (cp >= 0x80).astype(np.int32) + (cp >= 0x800) + (cp >= 0x10000)
    cls = char_classes()[cp]
    cls[ends] = END
    starts = _word_starts(cp, cls)
    at = np.flatnonzero(starts)
    marks = cls[at] == END
    offsets = at if width is None else (np.cumsum(width) - width)[at]
    offsets = np.append(offsets, len(raw)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    counts = np.diff(np.flatnonzero(marks), prepend=-1) - 1
    return words.filter(pa.array(~marks)), counts


def words_of(texts: list[str | None]) -> tuple[pa.ChunkedArray, np.ndarray]:
    """All words of ``texts`` in order, and how many each text has (0 for empty and null)."""
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for piece in _pieces(text or ""):
            parts.append(piece)
            owner.append(i)
    chunks, counts, at = [], [], 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= PIECE):
            size += len(parts[to])
            to += 1
        words, n = _batch_words(parts[at:to])
        chunks.append(words)
        counts.append(n)
        at = to
    per = np.bincount(np.array(owner, np.int64), np.concatenate(counts), len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)
    return pa.chunked_array(chunks, pa.binary()), per
