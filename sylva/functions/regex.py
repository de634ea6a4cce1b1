"""Regular expressions of W3C XML Schema with set operations, by derivatives: leftmost and longest matches.

Besides the W3C syntax: a{|}b ordered choice, a{&}b intersection, a{\\}b difference, a{^}b exclusive or, a{:}b interleaving,
({name}a) a labelled part. Plain functions work on strings; the *_col functions on columns, and go to Java's
engine where it gives the same answer.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charset as C

ZERO, UNIT = ("zero",), ("unit",)
DOT = ("sym", C.complement(C.of("\n\r")))
ANY = ("sym", C.ALL)
INF = -1


def sym(s: C.Set):
    return ("sym", s) if s else ZERO


def seq(a, b):
    if a == ZERO or b == ZERO:
        return ZERO
    if a == UNIT:
        return b
    if b == UNIT:
        return a
    if a[0] == "seq":
        return ("seq", a[1], seq(a[2], b))
    return ("seq", a, b)


def alt(a, b):
    if a == ZERO or a == b:
        return b
    if b == ZERO:
        return a
    if a[0] == b[0] == "sym":
        return sym(C.union(a[1], b[1]))
    parts = []
    for x in (a, b):
        while x[0] == "alt":
            parts.append(x[1])
            x = x[2]
        parts.append(x)
    parts = list(dict.fromkeys(parts))
    out = parts[-1]
    for x in reversed(parts[:-1]):
        out = ("alt", x, out)
    return out


def orelse(a, b):
    return b if a == ZERO else a if b == ZERO or a == b else ("else", a, b)


def star(a):
    return UNIT if a in (ZERO, UNIT) else a if a[0] == "star" else ("star", a)


def rng(i: int, j: int, a):
    """a from i to j times; j is INF for no bound."""
    if j == 0 or a == UNIT:
        return UNIT
    if i == 0 and j == INF:
        return star(a)
    if (i, j) == (1, 1):
        return a
    if a == ZERO:
        return UNIT if i == 0 else ZERO
    return ("rng", i, j, a)


def opt(a):
    return rng(0, 1, a)


def isect(a, b):
    return ZERO if ZERO in (a, b) else a if a == b else ("isect", a, b)


def diff(a, b):
    return a if b == ZERO else ZERO if a in (ZERO, b) else ("diff", a, b)


def exor(a, b):
    return b if a == ZERO else a if b == ZERO else ZERO if a == b else ("exor", a, b)


def interleave(a, b):
    return ZERO if ZERO in (a, b) else b if a == UNIT else a if b == UNIT else ("inter", a, b)


def complement(a):
    return diff(star(ANY), a)


def word(s: str):
    out = UNIT
    for c in reversed(s):
        out = seq(sym(C.of(c)), out)
    return out


def bracket(label: str, a, got: str = ""):
    return ZERO if a == ZERO else ("br", label, got, a)


@lru_cache(maxsize=1 << 15)
def nullable(r) -> bool:
    k = r[0]
    if k in ("unit", "star"):
        return True
    if k in ("zero", "sym"):
        return False
    if k in ("alt", "else"):
        return nullable(r[1]) or nullable(r[2])
    if k in ("seq", "isect", "inter"):
        return nullable(r[1]) and nullable(r[2])
    if k == "diff":
        return nullable(r[1]) and not nullable(r[2])
    if k == "exor":
        return nullable(r[1]) != nullable(r[2])
    if k == "rng":
        return r[1] == 0 or nullable(r[3])
    return nullable(r[3] if k == "br" else r[2])


def parts(r) -> tuple:
    """(label, text) of the labelled parts of a nullable expression."""
    k = r[0]
    if k == "br":
        return ((r[1], r[2]), *parts(r[3]))
    if k == "done":
        return (*r[1], *parts(r[2]))
    if k in ("alt", "else"):
        return parts(r[1]) if nullable(r[1]) else parts(r[2])
    if k in ("seq", "isect", "inter"):
        return (*parts(r[1]), *parts(r[2]))
    if k == "diff":
        return parts(r[1])
    if k == "exor":
        return parts(r[1]) if nullable(r[1]) else parts(r[2])
    if k == "rng":
        return parts(r[3]) if nullable(r[3]) and r[1] else ()
    return ()


def _done(got: tuple, r):
    return r if not got or r == ZERO else ("done", got, r)


@lru_cache(maxsize=1 << 16)
def delta(r, c: str):
    """What is left to match after one character."""
    k = r[0]
    if k in ("zero", "unit"):
        return ZERO
    if k == "sym":
        return UNIT if C.member(c, r[1]) else ZERO
    if k == "star":
        return seq(delta(r[1], c), r)
    if k == "alt":
        return alt(delta(r[1], c), delta(r[2], c))
    if k == "else":
        return orelse(delta(r[1], c), delta(r[2], c))
    if k == "seq":
        d = seq(delta(r[1], c), r[2])
        return alt(d, _done(parts(r[1]), delta(r[2], c))) if nullable(r[1]) else d
    if k == "rng":
        i, j, a = r[1:]
        return seq(delta(a, c), rng(max(0, i - 1), INF if j == INF else j - 1, a))
    if k == "isect":
        return isect(delta(r[1], c), delta(r[2], c))
    if k == "diff":
        return diff(delta(r[1], c), delta(r[2], c))
    if k == "exor":
        return exor(delta(r[1], c), delta(r[2], c))
    if k == "inter":
        return alt(interleave(delta(r[1], c), r[2]), interleave(r[1], delta(r[2], c)))
    if k == "br":
        return bracket(r[1], delta(r[3], c), r[2] + c)
    return _done(r[1], delta(r[2], c))


@lru_cache(maxsize=1 << 12)
def first_chars(r) -> C.Set:
    """Characters with which a match that is not empty can begin."""
    k = r[0]
    if k == "sym":
        return r[1]
    if k in ("zero", "unit"):
        return C.EMPTY
    if k in ("alt", "else", "exor", "inter"):
        return C.union(first_chars(r[1]), first_chars(r[2]))
    if k == "isect":
        return C.intersection(first_chars(r[1]), first_chars(r[2]))
    if k == "seq":
        return C.union(first_chars(r[1]), first_chars(r[2])) if nullable(r[1]) else first_chars(r[1])
    return first_chars({"star": r[1], "diff": r[1], "rng": r[-1], "br": r[-1], "done": r[-1]}[k])


class RegexError(ValueError):
    """A pattern that cannot be read."""


class _Parser:
    def __init__(self, source: str, extended: bool):
        self.s, self.at, self.ext = source, 0, extended

    def look(self, t: str) -> bool:
        return self.s.startswith(t, self.at)

    def take(self, t: str) -> bool:
        if self.look(t):
            self.at += len(t)
            return True
        return False

    def need(self, t: str) -> None:
        if not self.take(t):
            raise RegexError(f"expected {t} at {self.at} of {self.s!r}")

    def regex(self, level: int = 0):
        levels = (("|", alt), ("{|}", orelse), ("{:}", interleave), ("{^}", exor), ("{\\}", diff), ("{&}", isect))
        if level == len(levels):
            return self.branch()
        mark, f = levels[level]
        out = self.regex(level + 1)
        while (level == 0 or self.ext) and self.look(mark):
            self.at += len(mark)
            out = f(out, self.regex(level + 1))
        return out

    def branch(self):
        out = []
        while self.at < len(self.s) and self.s[self.at] not in "|)" and not (self.ext and re.match(r"\{[|:^\\&]\}", self.s[self.at :])):
            out.append(self.piece())
        r = UNIT
        for x in reversed(out):
            r = seq(x, r)
        return r

    def piece(self):
        a = self.atom()
        while self.at < len(self.s):
            if self.take("*"):
                a = star(a)
            elif self.take("+"):
                a = rng(1, INF, a)
            elif self.take("?"):
                a = opt(a)
            elif m := re.compile(r"\{(\d+)(,(\d*))?\}").match(self.s, self.at):
                self.at = m.end()
                low = int(m[1])
                high = low if m[2] is None else int(m[3]) if m[3] else INF
                if high not in (INF,) and high < low:
                    raise RegexError("the range is empty")
                a = rng(low, high, a)
            else:
                break
        return a

    def atom(self):
        c = self.s[self.at]
        self.at += 1
        if c == "(":
            label = None
            if self.ext and (m := re.compile(r"\{([\w:.-]+)\}").match(self.s, self.at)):
                label, self.at = m[1], m.end()
            a = self.regex()
            self.need(")")
            return a if label is None else bracket(label, a)
        if c == "[":
            return sym(self.char_class())
        if c == ".":
            return DOT
        if c == "\\":
            if self.ext and self.at < len(self.s) and self.s[self.at] in "aA":
                self.at += 1
                return ANY if self.s[self.at - 1] == "a" else star(ANY)
            return sym(self.escape())
        if c in "*+?{}])":
            raise RegexError(f"{c} has nothing before it")
        return sym(C.of(c))

    def escape(self) -> C.Set:
        if self.at >= len(self.s):
            raise RegexError("a backslash ends the pattern")
        c = self.s[self.at]
        self.at += 1
        if c in "nrt":
            return C.of({"n": "\n", "r": "\r", "t": "\t"}[c])
        if c in "pP":
            self.need("{")
            end = self.s.index("}", self.at)
            name, self.at = self.s[self.at : end], end + 1
            s = _block(name[2:]) if name.startswith("Is") else C.category(name)
            return C.complement(s) if c == "P" else s
        sets = {"s": lambda: C.SPACE, "d": lambda: C.DIGIT, "i": lambda: C.NAME_START, "c": lambda: C.NAME_CHAR, "w": lambda: C.complement(C.union(C.union(C.category("P"), C.category("Z")), C.category("C")))}
        if c.lower() in sets:
            s = sets[c.lower()]()
            return C.complement(s) if c.isupper() else s
        if c.isalnum():
            raise RegexError(f"unknown escape \\{c}")
        return C.of(c)

    def char_class(self) -> C.Set:
        negative, out = self.take("^"), C.EMPTY
        first = True
        while first or not self.look("]"):
            first = False
            if self.at >= len(self.s):
                raise RegexError("a character class does not end")
            if self.look("-["):
                self.at += 2
                out = C.complement(out) if negative else out
                out = C.difference(out, self.char_class())
                self.need("]")
                return out
            lo = self.one()
            if len(lo) == 1 and lo[0][0] == lo[0][1] and self.look("-") and not self.look("-]") and not self.look("-["):
                self.at += 1
                hi = self.one()
                if hi[0][0] < lo[0][0]:
                    raise RegexError("a range runs backwards")
                lo = ((lo[0][0], hi[0][0]),)
            out = C.union(out, lo)
        self.need("]")
        return C.complement(out) if negative else out

    def one(self) -> C.Set:
        c = self.s[self.at]
        self.at += 1
        return self.escape() if c == "\\" else C.of(c)


_BLOCKS = {"BasicLatin": (0, 0x7F), "Latin-1Supplement": (0x80, 0xFF), "LatinExtended-A": (0x100, 0x17F), "LatinExtended-B": (0x180, 0x24F), "Greek": (0x370, 0x3FF), "GreekandCoptic": (0x370, 0x3FF), "Cyrillic": (0x400, 0x4FF), "Hebrew": (0x590, 0x5FF), "Arabic": (0x600, 0x6FF), "Hiragana": (0x3040, 0x309F), "Katakana": (0x30A0, 0x30FF), "CJKUnifiedIdeographs": (0x4E00, 0x9FFF), "GeneralPunctuation": (0x2000, 0x206F)}


def _block(name: str) -> C.Set:
    if name not in _BLOCKS:
        raise RegexError(f"unknown block {name}")
    return C.norm([_BLOCKS[name]])


@lru_cache(maxsize=1024)
def parse(source: str, extended: bool = True):
    p = _Parser(source, extended)
    r = p.regex()
    if p.at < len(source):
        raise RegexError(f"unexpected {source[p.at :]!r}")
    return r


def glob(source: str, nocase: bool = False):
    """An expression of a file pattern: * ? [..] {a,b}."""
    out, k = UNIT, 0
    stack: list = []
    alts: list = []
    while k < len(source):
        c = source[k]
        k += 1
        if c == "*":
            a = star(ANY)
        elif c == "?":
            a = ANY
        elif c == "[":
            end = source.index("]", k + 1)
            body = source[k:end]
            p = _Parser(("[^" if body[:1] == "!" else "[") + body.lstrip("!") + "]", False)
            a, k = p.atom(), end + 1
        elif c == "{":
            stack.append((out, alts))
            out, alts = UNIT, []
            continue
        elif c == "," and stack:
            alts.append(out)
            out = UNIT
            continue
        elif c == "}" and stack:
            a = out
            for x in alts:
                a = alt(x, a)
            out, alts = stack.pop()
        else:
            if c == "\\" and k < len(source):
                c, k = source[k], k + 1
            a = sym(C.of(c.lower() + c.upper()) if nocase and len(c.lower() + c.upper()) == 2 else C.of(c))
        out = seq(out, a)
    return out


def _compiled(r):
    return parse(r) if isinstance(r, str) else r


def match(r, s: str) -> bool:
    """Whether the whole text matches."""
    r = _compiled(r)
    for c in s:
        r = delta(r, c)
        if r == ZERO:
            return False
    return nullable(r)


def match_subex(r, s: str) -> list[tuple[str, str]]:
    """The labelled parts of a whole match, else nothing."""
    r = _compiled(r)
    for c in s:
        r = delta(r, c)
    return list(parts(r)) if nullable(r) else []


def _prefix(r, s: str, at: int) -> tuple[int, tuple] | None:
    """End and labelled parts of the longest match at a place."""
    best = (at, parts(r)) if nullable(r) else None
    for k in range(at, len(s)):
        r = delta(r, s[k])
        if r == ZERO:
            break
        if nullable(r):
            best = (k + 1, parts(r))
    return best


def split(r, s: str) -> tuple[str, str]:
    """The longest matching prefix and the rest; '' and the text if there is none."""
    got = _prefix(_compiled(r), s, 0)
    return (s[: got[0]], s[got[0] :]) if got else ("", s)


def split_subex(r, s: str) -> tuple[list[tuple[str, str]], str]:
    got = _prefix(_compiled(r), s, 0)
    return (list(got[1]), s[got[0] :]) if got else ([], s)


def _scan(r, s: str):
    """(start, end, parts) of the tokens, leftmost and longest; an empty match takes a character with it."""
    r = _compiled(r)
    first, empty, at = first_chars(r), nullable(r), 0
    while at < len(s):
        if not empty and not C.member(s[at], first):
            at += 1
            continue
        got = _prefix(r, s, at)
        if got is None:
            at += 1
            continue
        yield at, got[0], got[1]
        at = max(got[0], at + 1)


def tokenize(r, s: str) -> list[str]:
    """All tokens; what does not match is dropped."""
    return [s[a:b] for a, b, _ in _scan(r, s)]


def tokenize_all(r, s: str) -> list[tuple[bool, str]]:
    """Tokens (True) and what is between them (False), nothing lost."""
    out, at = [], 0
    for a, b, _ in _scan(r, s):
        if a > at:
            out.append((False, s[at:a]))
        if b > a:
            out.append((True, s[a:b]))
        at = max(at, b)
    return out + ([(False, s[at:])] if at < len(s) else [])


def tokenize_subex(r, s: str) -> list[tuple[str, str]]:
    return [p for _, _, got in _scan(r, s) for p in got]


def sed(edit: Callable[[str], str], r, s: str) -> str:
    """The text with every token edited."""
    return "".join(edit(t) if hit else t for hit, t in tokenize_all(r, s))


def context(source: str):
    """A grep pattern: ^ and $ bind it to the ends, \\< and \\> to words' ends; else it may lie anywhere."""
    start, end = source.startswith("^"), source.endswith("$") and not source.endswith("\\$")
    body = source[start : len(source) - end]
    left, right = body.startswith("\\<"), body.endswith("\\>")
    body = body[2 * left : len(body) - 2 * right]
    nonword = C.complement(C.union(C.category("L"), C.DIGIT))
    a = parse(body)
    before = UNIT if start else opt(seq(star(ANY), sym(nonword))) if left else star(ANY)
    after = UNIT if end else opt(seq(sym(nonword), star(ANY))) if right else star(ANY)
    return seq(before, seq(a, after))


def grep(source: str, lines: list[str]) -> list[str]:
    r = context(source)
    return [x for x in lines if match(r, x)]


def grep_numbered(source: str, lines: list[str]) -> list[tuple[int, str]]:
    r = context(source)
    return [(k, x) for k, x in enumerate(lines, 1) if match(r, x)]


# columns


def _chars(s: C.Set) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in s) + "]"


def to_java(r) -> str | None:
    """A Java pattern with the same whole-text matches, or None if there is none without set operations."""
    k = r[0]
    if k == "unit":
        return ""
    if k == "zero":
        return "(?!)"
    if k == "sym":
        return _chars(r[1]) if len(r[1]) <= 64 else None
    if k in ("alt", "else"):
        a, b = to_java(r[1]), to_java(r[2])
        return None if a is None or b is None else f"(?:{a}|{b})"
    if k == "seq":
        a, b = to_java(r[1]), to_java(r[2])
        return None if a is None or b is None else a + b
    if k in ("star", "rng"):
        a = to_java(r[-1])
        mark = "*" if k == "star" else f"{{{r[1]},{'' if r[2] == INF else r[2]}}}"
        return None if a is None else f"(?:{a}){mark}"
    if k == "br":
        return to_java(r[3])
    return None


def match_col(s: Column, source: str) -> Column:
    """Whole-text match of a column: intersections, differences and exclusive ors become conditions, the rest Java patterns."""
    return _match_col(s, parse(source))


def _match_col(s: Column, r) -> Column:
    java = to_java(r)
    if java is not None:
        return s.rlike(f"\\A(?:{java})\\z")
    if r[0] in ("isect", "diff", "exor"):
        a, b = _match_col(s, r[1]), _match_col(s, r[2])
        return {"isect": a & b, "diff": a & ~b, "exor": a != b}[r[0]]

    @F.pandas_udf("boolean")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else match(r, v))

    return f(s)


def tokenize_col(s: Column, source: str) -> Column:
    r = parse(source)

    @F.pandas_udf("array<string>")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else tokenize(r, v))

    return f(s)


def sed_col(s: Column, source: str, edit: Callable[[str], str]) -> Column:
    r = parse(source)

    @F.pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else sed(edit, r, v))

    return f(s)


def split_col(s: Column, source: str) -> Column:
    r = parse(source)

    @F.pandas_udf("token string, rest string")
    def f(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split(r, v or "") for v in x], columns=["token", "rest"])

    return f(s)


def subex_col(s: Column, source: str) -> Column:
    """The labelled parts of whole matches, as a map."""
    r = parse(source)

    @F.pandas_udf("map<string,string>")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else dict(match_subex(r, v)))

    return f(s)


def grep_col(s: Column, source: str) -> Column:
    """Lines (number, line) of a text that a grep pattern finds."""
    r = context(source)
    java = to_java(r)
    lines = F.transform(F.split(s, "\n", -1), lambda x, k: F.struct((k + 1).alias("n"), x.alias("line")))
    if java is not None:
        return F.filter(lines, lambda x: x["line"].rlike(f"(?s)\\A(?:{java})\\z"))

    @F.pandas_udf("array<struct<n:int,line:string>>")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [] if v is None else [{"n": k, "line": t} for k, t in enumerate(v.split("\n"), 1) if match(r, t)])

    return f(s)
