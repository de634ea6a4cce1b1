"""W3C Schema datatypes and facets: checks of strings, and the same as column conditions where SQL has them."""

from __future__ import annotations

import base64
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regex

RANGES: dict[str, tuple[int | None, int | None]] = {
    "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
_NAME = r"[A-Za-z_:À-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍、-퟿][-\w.:·]*"
_NCNAME = _NAME.replace("_:", "_").replace(".:", ".")
_TZ = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?"
_YEAR = r"-?(?:[1-9]\d{3,}|0\d{3})"
LEXICAL = {
    "boolean": r"true|false|0|1", "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", "float": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN", "double": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN",
    "language": r"[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*", "NMTOKEN": r"[-\w.:·]+", "Name": _NAME, "NCName": _NCNAME, "ID": _NCNAME, "IDREF": _NCNAME, "ENTITY": _NCNAME,
    "QName": rf"(?:{_NCNAME}:)?{_NCNAME}", "NOTATION": rf"(?:{_NCNAME}:)?{_NCNAME}", "hexBinary": r"(?:[0-9A-Fa-f]{2})*", "base64Binary": r"(?:(?:[A-Za-z0-9+/] ?){4})*(?:(?:[A-Za-z0-9+/] ?){2}= ?=|(?:[A-Za-z0-9+/] ?){3}=)?",
    "duration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?",
    "dateTime": rf"{_YEAR}-\d\d-\d\dT(?:{_TIME}){_TZ}", "date": rf"{_YEAR}-\d\d-\d\d{_TZ}", "time": rf"(?:{_TIME}){_TZ}", "gYearMonth": rf"{_YEAR}-(?:0[1-9]|1[0-2]){_TZ}", "gYear": rf"{_YEAR}{_TZ}",
    "gMonthDay": rf"--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]){_TZ}", "gMonth": rf"--(?:0[1-9]|1[0-2]){_TZ}", "gDay": rf"---(?:0[1-9]|[12]\d|3[01]){_TZ}",
}
LISTS = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}
TYPES = frozenset((*LEXICAL, *RANGES, *LISTS, "string", "normalizedString", "token", "anyURI", "anySimpleType", "anyType", "anyAtomicType"))
_RE = {k: re.compile(v) for k, v in LEXICAL.items()}


def white_space(s: str, mode: str) -> str:
    if mode == "preserve":
        return s
    s = re.sub(r"[\t\n\r]", " ", s)
    return s if mode == "replace" else " ".join(x for x in s.split(" ") if x)


def mode_of(kind: str) -> str:
    return {"string": "preserve", "anySimpleType": "preserve", "anyType": "preserve", "normalizedString": "replace"}.get(kind, "collapse")


def _date_ok(s: str) -> bool:
    m = re.match(r"(-?\d{4,})-(\d\d)-(\d\d)", s)
    if not m:
        return True
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 1 <= mo <= 12 and 1 <= d <= (29 if mo == 2 and leap else 28 if mo == 2 else 30 if mo in (4, 6, 9, 11) else 31)


def value(kind: str, s: str):
    """The value a text stands for, for comparisons; the text itself where the type has no order."""
    s = white_space(s, mode_of(kind))
    if kind in RANGES:
        return int(s)
    if kind == "decimal":
        return Decimal(s)
    if kind in ("float", "double"):
        return float(s.replace("INF", "inf"))
    if kind == "boolean":
        return s in ("true", "1")
    if kind == "hexBinary":
        return bytes.fromhex(s)
    if kind == "base64Binary":
        return base64.b64decode(s)
    if kind == "duration":
        m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?", s)
        n = [Decimal(x or 0) for x in m.groups()[1:]] if m else [Decimal(0)] * 6
        sign = -1 if s.startswith("-") else 1
        return (sign * (n[0] * 12 + n[1]), sign * (n[2] * 86400 + n[3] * 3600 + n[4] * 60 + n[5]))
    if kind in ("dateTime", "date", "time") or kind.startswith("g"):
        return _moment(s)
    return s


def _moment(s: str) -> tuple:
    """Parts of a date or time, moved to UTC where it has a zone."""
    zone = re.search(r"(?:(?<=\d)|(?<=T))(Z|[+-]\d\d:\d\d)$", s) if not re.fullmatch(r"-{2,3}\d\d(-\d\d)?", s) else None
    body, shift = (s[: zone.start()], zone[1]) if zone else (s, "")
    m = re.fullmatch(r"(?:(-?\d{4,})(?:-(\d\d)(?:-(\d\d))?)?)?(?:T?(\d\d):(\d\d):([\d.]+))?", body)
    if not m:
        n = [int(x) for x in re.findall(r"\d+", body)]
        return ("md", *n)
    y, mo, d, h, mi = (int(x) if x else None for x in m.groups()[:5])
    sec = Decimal(m[6] or 0)
    off = 0 if shift in ("", "Z") else (1 if shift[0] == "+" else -1) * (int(shift[1:3]) * 60 + int(shift[4:6]))
    days = 0 if y is None else 365 * y + y // 4 - y // 100 + y // 400 + (367 * (mo or 1) - 362) // 12 + (d or 1)
    return (Decimal(days * 86400 + ((h or 0) * 60 + (mi or 0) - off) * 60) + sec,)


def allows(kind: str, s: str, facets: dict[str, str | list[str]] | None = None, digits_equal: bool = False) -> str | None:
    """None if the text is of the type and keeps to the facets, else what is wrong. digits_equal takes digit facets as exact counts."""
    if kind not in TYPES:
        return f"unknown type {kind}"
    raw, facets = s, facets or {}
    s = white_space(raw, str(facets.get("whiteSpace", mode_of(kind))))
    items = s.split() if kind in LISTS else None
    if items is not None:
        if not items or any(not _RE[LISTS[kind]].fullmatch(x) for x in items):
            return f"{raw!r} is not a list of {LISTS[kind]}"
    elif kind in RANGES:
        if not re.fullmatch(r"[+-]?\d+", s):
            return f"{raw!r} is not a whole number"
        low, high = RANGES[kind]
        if low is not None and int(s) < low or high is not None and int(s) > high:
            return f"{raw!r} is out of the range of {kind}"
    elif kind in _RE and not _RE[kind].fullmatch(s) or kind in ("date", "dateTime") and not _date_ok(s):
        return f"{raw!r} is not a {kind}"
    elif kind == "anyURI" and re.search(r"[\s<>{}|\\^`]", s):
        return f"{raw!r} is not a {kind}"
    size = len(items) if items is not None else len(value(kind, s)) if kind in ("hexBinary", "base64Binary") else len(s)
    for name, given in facets.items():
        many = given if isinstance(given, list) else [given]
        if name == "pattern":
            if not any(regex.match(regex.parse(p, False), s) for p in many):
                return f"{raw!r} does not match the pattern {' or '.join(many)}"
        elif name == "enumeration":
            try:
                if not any(value(kind, s) == value(kind, x) for x in many):
                    return f"{raw!r} is not one of {', '.join(many)}"
            except (ValueError, InvalidOperation):
                return f"{raw!r} is not one of {', '.join(many)}"
        elif name in ("length", "minLength", "maxLength"):
            n = int(many[0])
            if name == "length" and size != n or name == "minLength" and size < n or name == "maxLength" and size > n:
                return f"{raw!r} does not keep to {name} {n}"
        elif name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            a, b = value(kind, s), value(kind, many[0])
            ok = {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[name]
            if not ok:
                return f"{raw!r} does not keep to {name} {many[0]}"
        elif name in ("totalDigits", "fractionDigits"):
            whole, _, part = s.lstrip("+-").partition(".")
            part = part.rstrip("0")
            n = len(part) if name == "fractionDigits" else len(whole.lstrip("0")) + len(part)
            if n != int(many[0]) if digits_equal else n > int(many[0]):
                return f"{raw!r} does not keep to {name} {many[0]}"
    return None


def equal(kind: str, a: str, b: str) -> bool:
    try:
        return value(kind, a) == value(kind, b)
    except (ValueError, InvalidOperation):
        return a == b


_MYSQL_INT = {"TINYINT": 8, "SMALLINT": 16, "MEDIUMINT": 24, "INT": 32, "BIGINT": 64}
_MYSQL_TEXT = {"CHAR": 255, "VARCHAR": 255, "BINARY": 255, "VARBINARY": 255, "TINYTEXT": 255, "TINYBLOB": 255, "TEXT": 65535, "BLOB": 65535, "MEDIUMTEXT": 2**24 - 1, "MEDIUMBLOB": 2**24 - 1, "LONGTEXT": 2**32 - 1, "LONGBLOB": 2**32 - 1}


def allows_mysql(kind: str, s: str, params: dict[str, str] | None = None) -> str | None:
    """The types of a MySQL column: whole numbers (SIGNED-, UNSIGNED-) and texts with their greatest length."""
    sign, _, name = kind.partition("-") if "-" in kind else ("SIGNED", "", kind)
    if name in _MYSQL_INT:
        bits = _MYSQL_INT[name]
        low, high = (0, 2**bits - 1) if sign == "UNSIGNED" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        return None if re.fullmatch(r"-?\d+", s) and low <= int(s) <= high else f"{s!r} is not a {kind}"
    if name not in _MYSQL_TEXT:
        return f"unknown type {kind}"
    for k, v in (params or {}).items():
        if k == "minLength" and len(s) < int(v) or k in ("length", "maxLength") and len(s) > int(v):
            return f"{s!r} does not keep to {k} {v}"
    return None if len(s) <= _MYSQL_TEXT[name] else f"{s!r} is too long for {kind}"


def check_col(s: Column, kind: str, **facets) -> Column:
    """Whether a column's texts are of a type and keep to the facets; null texts are not."""
    t = s if mode_of(kind) == "preserve" else F.regexp_replace(s, r"[\t\n\r]", " ") if mode_of(kind) == "replace" else F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))
    ok = F.lit(True)
    if kind in RANGES:
        big = t.try_cast("decimal(38,0)")
        ok = t.rlike(r"^[+-]?[0-9]+$")
        low, high = RANGES[kind]
        if low is not None:
            ok &= F.coalesce(big >= F.lit(str(low)).cast("decimal(38,0)"), F.lit(False))
        if high is not None:
            ok &= F.coalesce(big <= F.lit(str(high)).cast("decimal(38,0)"), F.lit(False))
    elif kind in LISTS:
        ok = (F.length(t) > 0) & F.forall(F.split(t, " "), lambda x: x.rlike(f"^(?U:{LEXICAL[LISTS[kind]]})$"))
    elif kind in LEXICAL:
        ok = t.rlike(f"^(?:{LEXICAL[kind]})$")
        if kind in ("date", "dateTime"):
            ok &= F.substring(t, 1, 10).try_cast("date").isNotNull() | ~t.rlike(r"^[0-9]{4}-")
    numeric = kind in RANGES or kind in ("decimal", "float", "double")
    v = t.try_cast("double" if kind in ("float", "double") else "decimal(38,10)") if numeric else t
    bound = lambda x: F.lit(str(x)).cast("double" if kind in ("float", "double") else "decimal(38,10)") if numeric else F.lit(str(x))
    for name, x in facets.items():
        n = F.size(F.split(t, " ")) if kind in LISTS else F.char_length(t)
        test = {
            "pattern": lambda: regex.match_col(t, x),
            "enumeration": lambda: t.isin(*x),
            "length": lambda: n == x,
            "minLength": lambda: n >= x,
            "maxLength": lambda: n <= x,
            "minInclusive": lambda: v >= bound(x),
            "maxInclusive": lambda: v <= bound(x),
            "minExclusive": lambda: v > bound(x),
            "maxExclusive": lambda: v < bound(x),
            "totalDigits": lambda: F.length(F.regexp_replace(F.regexp_replace(t, r"^[+-]?0*", ""), r"\.|(\.[0-9]*?)0+$", "")) <= x,
            "fractionDigits": lambda: F.length(F.regexp_extract(t, r"\.([0-9]*?)0*$", 1)) <= x,
        }[name]()
        ok &= test
    return F.coalesce(ok, F.lit(False))
