"""XPath's core functions as column expressions, and escaping of text. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\r\n]+"


def starts_with(s: Column, t: Column) -> Column:
    return s.startswith(t)


def contains(s: Column, t: Column) -> Column:
    return s.contains(t)


def substring_before(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when((at > 0) & (F.length(t) > 0), F.substring(s, F.lit(1), at - 1)).otherwise(F.lit(""))


def substring_after(s: Column, t: Column) -> Column:
    at = F.position(t, s)
    return F.when(F.length(t) == 0, s).when(at > 0, F.substring(s, at + F.length(t), F.length(s))).otherwise(F.lit(""))


def round_(x: Column) -> Column:
    """The nearest whole number, halves upwards, as a double."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x + 0.5).cast("double"))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From the first position on, counted from 1 and rounded; positions out of the text are passed over, NaN gives ''."""
    low = round_(start.cast("double"))
    high = low + round_(length.cast("double")) if length is not None else F.lit(float("inf"))
    first = F.greatest(low, F.lit(1.0))
    last = F.least(high, F.length(s).cast("double") + 1)
    ok = ~F.isnan(low) & ~F.isnan(high) & (last > first)
    return F.when(ok, F.substring(s, first.cast("int"), (last - first).cast("int"))).otherwise(F.lit(""))


def string_length(s: Column) -> Column:
    return F.char_length(s)


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, _WS, " "))


def translate(s: Column, old: str, new: str, strict: bool = False) -> Column:
    """Replaces characters one after the other (a replacement may be replaced again); strict does it at once."""
    if strict:
        return F.translate(s, old, new)
    for k, c in enumerate(old):
        s = F.replace(s, F.lit(c), F.lit(new[k] if k < len(new) else ""))
    return s


def number(s: Column) -> Column:
    """The number a text stands for, NaN if none: digits with a point and a minus sign, no exponent."""
    return F.when(s.rlike(r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ \t\r\n]*$"), F.trim(s).cast("double")).otherwise(F.lit(float("nan")))


def boolean_of_number(x: Column) -> Column:
    return (x != 0) & ~F.isnan(x)


def boolean_of_string(s: Column) -> Column:
    return F.length(s) > 0


def string_of_number(x: Column) -> Column:
    """Whole numbers without a fraction, and NaN and Infinity by name."""
    return (
        F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("Infinity")).when(x == float("-inf"), F.lit("-Infinity"))
        .when((x == F.floor(x).cast("double")) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))
    )


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceiling(x: Column) -> Column:
    return F.ceil(x).cast("double")


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN instead of an error."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)


def mod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(None)).otherwise(b))


def escape_text(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_attr(s: Column) -> Column:
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        s = F.replace(s, F.lit(c), F.lit(e))
    return s


def normalize_newlines(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
