"""Patterns of the linear-time dialect (RE2's) as Java patterns that match the same texts; what has no equal is refused.

Java's engine backtracks: unlike the original dialect, running time is not bounded by the length of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from strataq.plans.errors import QueryError

# The named ASCII classes, by the names Java has for them.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit",
}
#: A blank, as \s has it; Java's has the vertical tab too.
BLANKS = "\\t\\n\\f\\r "
MOST_REPEATS = 1000


@dataclass
class Options:
    every: bool = False
    fold: bool = False
    dot_all: bool = False
    literal: bool = False


def options(text: str) -> Options:
    """Option letters in order, so that the last of a pair wins. m, n and p say that . leaves out the line end."""
    out = Options()
    for c in text:
        if c == "g":
            out.every = True
        elif c in "ic":
            out.fold = c == "i"
        elif c in "smnp":
            out.dot_all = c == "s"
        elif c == "l":
            out.literal = True
        elif c not in " \t\n":
            raise QueryError("BadRegexOption", f"{c!r} in {text!r}")
    return out


def _refuse(what: str) -> QueryError:
    return QueryError("UnsupportedRegex", f"{what} is not supported")


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.i, self.out, self.groups = pattern, 0, [], 0
        self.lines = [False]  # whether ^ and $ stand for lines, by depth of groups
        self.repeatable = False

    def run(self) -> str:
        while self.i < len(self.p):
            c = self.p[self.i]
            if c in "*+?" or (c == "{" and self._counted()):
                self._repeat(c)
                continue
            self.repeatable = True
            if c == "\\":
                self.out.append(self._escape(inside=False))
            elif c == "[":
                self._class()
            elif c == "(":
                self._open()
            elif c == ")":
                if len(self.lines) == 1:
                    raise QueryError("BadRegex", "unmatched )")
                self.lines.pop()
                self._put(")")
            elif c == "|":
                self._put("|")
                self.repeatable = False
            elif c == "^":
                self._put("(?:\\A|(?<=\\n))" if self.lines[-1] else "\\A")
            elif c == "$":
                self._put("(?=\\n|\\z)" if self.lines[-1] else "\\z")
            else:
                self._put("\\" + c if c in "{}]" else c)
        if len(self.lines) > 1:
            raise QueryError("BadRegex", "unmatched (")
        return "".join(self.out)

    def _put(self, text: str, width: int = 1) -> None:
        self.out.append(text)
        self.i += width

    def _counted(self) -> re.Match | None:
        return re.compile(r"\{(\d+)(,(\d*))?\}").match(self.p, self.i)

    def _repeat(self, c: str) -> None:
        if not self.repeatable:
            raise QueryError("BadRegex", f"nothing for {c} to repeat")
        size = 1
        if c == "{":
            m = self._counted()
            size = len(m[0])
            low, high = int(m[1]), int(m[3]) if m[3] else int(m[1])
            if max(low, high) > MOST_REPEATS or high < low:
                raise QueryError("BadRegex", f"bad repetition {m[0]}")
        if self.p[self.i + size : self.i + size + 1] == "?":
            size += 1
        self._put(self.p[self.i : self.i + size], size)
        self.repeatable = False

    def _escape(self, *, inside: bool) -> str:
        if self.i + 1 >= len(self.p):
            raise QueryError("BadRegex", "a pattern ends in a backslash")
        c = self.p[self.i + 1]
        self.i += 2
        if c == "s":
            return BLANKS if inside else f"[{BLANKS}]"
        if c == "S":
            return f"[^{BLANKS}]"
        if c in "dDwWnrtfa" or (c in "bBAz" and not inside):
            return "\\" + c
        if c == "v":
            return "\\x0B"
        if c == "x":
            m = re.compile(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})").match(self.p, self.i)
            if not m:
                raise QueryError("BadRegex", "\\x needs two digits, or some in braces")
            self.i = m.end()
            return "\\x{" + (m[1] or m[2]) + "}"
        if c.isalnum() and c.isascii():
            raise _refuse("\\" + c)
        return "\\" + c

    def _class(self) -> None:
        self.i += 1
        out = ["["]
        if self.p[self.i : self.i + 1] == "^":
            out.append("^")
            self.i += 1
        first = True
        while True:
            if self.i >= len(self.p):
                raise QueryError("BadRegex", "unmatched [")
            c = self.p[self.i]
            if c == "]" and not first:
                break
            first = False
            named = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
            if named:
                if named[2] not in POSIX and named[2] not in ("space", "word"):
                    raise QueryError("BadRegex", named[0])
                plain = {"space": "[\\t\\n\\x0B\\f\\r ]", "word": "\\w"}.get(named[2]) or "\\p{" + POSIX[named[2]] + "}"
                out.append(f"[^{plain}]" if named[1] else plain)
                self.i = named.end()
            elif c == "\\":
                out.append(self._escape(inside=True))
            else:
                out.append("\\" + c if c in "[]&^" else c)
                self.i += 1
        self.i += 1
        self.out.append("".join(out) + "]")

    def _open(self) -> None:
        rest = self.p[self.i :]
        if not rest.startswith("(?"):
            self.groups += 1
            self.lines.append(self.lines[-1])
            self._put("(")
        elif m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest):
            self.groups += 1
            self.lines.append(self.lines[-1])
            self._put("(", len(m[0]))
        elif m := re.match(r"\(\?([ims]*)(?:-([ims]+))?([:)])", rest):
            on, off = m[1], m[2] or ""
            lines = "m" in on or (self.lines[-1] and "m" not in off)
            on, off = ("".join({"i": "iu", "s": "s"}.get(f, "") for f in part) for part in (on, off))
            flags = on + (f"-{off}" if off else "")
            if m[3] == ":":
                self.lines.append(lines)
                self._put(f"(?{flags}:", len(m[0]))
            else:
                self.lines[-1] = lines
                self._put(f"(?{flags})" if flags else "", len(m[0]))
        else:
            raise _refuse(rest[:3])
        self.repeatable = False


def to_java(pattern: str, how: Options) -> tuple[str, int]:
    """The pattern for Java and how many groups it has. Lines end in \\n alone; ^ and $ are the text's ends."""
    if how.literal:
        body, groups = re.sub(r"([^0-9A-Za-z_\s\x80-\U0010ffff])", r"\\\1", pattern), 0
    else:
        t = _Translator(pattern)
        body, groups = t.run(), t.groups
    return f"(?d{'iu' if how.fold else ''}{'s' if how.dot_all else ''}:{body})", groups


def pieces(replacement: str, groups: int) -> list[str | int]:
    """A replacement as texts and numbers of groups; \\0 is the match, \\\\ a backslash."""
    out: list[str | int] = []
    i = 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\":
            i += 1
            if i == len(replacement) or not (replacement[i].isdigit() or replacement[i] == "\\"):
                raise QueryError("BadRegex", "in a replacement, a digit or a backslash must follow a backslash")
            c = replacement[i]
            if c.isdigit():
                if int(c) > groups:
                    raise QueryError("BadRegex", f"no group {c}")
                out.append(int(c))
                i += 1
                continue
        out.append(c)
        i += 1
    return out
