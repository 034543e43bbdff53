"""Expressions for other engines, written from the parsed form."""

from __future__ import annotations

from tessera.plans import hir

#: Line ends as the parsed form means them, for engines whose own anchors know others.
_LINE_START = r"(?:(?<![\s\S])|(?<=\n)|(?<=\r)(?!\n))"
_LINE_END = r"(?:(?=\r)|(?<!\r)(?=\n)|(?![\s\S]))"


def line_local(node: hir.Node) -> bool:
    """Whether no match can hold or depend on anything outside its line."""
    match node:
        case hir.Literal(text):
            return "\n" not in text and "\r" not in text
        case hir.Class(ranges):
            return not any(lo <= c <= hi for lo, hi in ranges for c in (10, 13))
        case hir.Look(kind):
            return kind not in ("text_start", "text_end")
        case hir.Repeat(sub) | hir.Group(sub):
            return line_local(sub)
        case hir.Concat(subs) | hir.Alternatives(subs):
            return all(map(line_local, subs))
    return True


class _Writer:
    word_class = ""

    def char(self, code: int) -> str:
        raise NotImplementedError

    def named(self, ranges: hir.Ranges) -> str | None:
        return None

    def cls(self, ranges: hir.Ranges) -> str:
        known = self.named(ranges)
        if known:
            return known
        others = hir.negated(ranges)
        if not ranges:
            return r"(?!)"
        if not others:
            return r"[\s\S]"
        sign, shown = ("^", others) if len(others) < len(ranges) else ("", ranges)
        return f"[{sign}" + "".join(self.char(lo) if lo == hi else f"{self.char(lo)}-{self.char(hi)}" for lo, hi in shown) + "]"

    def look(self, kind: str) -> str:
        w = self.word()
        at_start, at_end = f"(?<!{w})(?={w})", f"(?<={w})(?!{w})"
        return {
            "line_start": _LINE_START, "line_end": _LINE_END, "text_start": r"(?<![\s\S])", "text_end": r"(?![\s\S])",
            "word": f"(?:{at_start}|{at_end})", "not_word": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))", "word_start": at_start, "word_end": at_end,
            "word_start_half": f"(?<!{w})", "word_end_half": f"(?!{w})",
        }[kind]

    def word(self) -> str:
        return self.cls(hir.property_ranges(hir.PERL["w"]))

    def write(self, node: hir.Node) -> str:
        match node:
            case hir.Empty():
                return ""
            case hir.Literal(text):
                return "".join(c if c.isascii() and c.isalnum() else self.char(ord(c)) for c in text)
            case hir.Class(ranges):
                return self.cls(ranges)
            case hir.Look(kind):
                return self.look(kind)
            case hir.Group(sub):
                return f"(?:{self.write(sub)})"
            case hir.Concat(subs):
                return "".join(self.write(s) if not isinstance(s, hir.Alternatives) else f"(?:{self.write(s)})" for s in subs)
            case hir.Alternatives(subs):
                return "(?:" + "|".join(map(self.write, subs)) + ")"
            case hir.Repeat(sub, low, high, greedy):
                times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or ("{%d}" % low if low == high else "{%d,%s}" % (low, "" if high is None else high))
                return f"(?:{self.write(sub)}){times}{'' if greedy else '?'}"
        raise TypeError(node)


class _Java(_Writer):
    def char(self, code: int) -> str:
        return r"\x{%x}" % code

    def named(self, ranges: hir.Ranges) -> str | None:
        for letter in "wds":
            full = hir.property_ranges(hir.PERL[letter])
            if ranges == full:
                return "\\" + letter
            if ranges == hir.negated(full):
                return "\\" + letter.upper()
        return None


class _Python(_Writer):
    def char(self, code: int) -> str:
        return r"\u%04x" % code if code < 0x10000 else r"\U%08x" % code


def to_java(node: hir.Node) -> str:
    """For the engine's ``rlike``; ``(?U)`` makes its short classes Unicode's."""
    return "(?U)" + _Java().write(node)


def to_python(node: hir.Node) -> str:
    return _Python().write(node)
