"""Character encodings and references, as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names under which encodings are asked for, and those of the JVM's charsets.
NAMES = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "ucs-2": "UTF-16"}
_HIGHEST = {"US-ASCII": 0x7F, "ISO-8859-1": 0xFF}


def _beyond(s: Column, highest: int, f: Callable[[Column], Column]) -> Column:
    """f in place of each character over highest."""
    each = F.transform(F.split(s, ""), lambda c: F.when(F.ascii(c) > highest, f(c)).otherwise(c))
    return F.when(s.rlike(rf"[^\x00-\x{{{highest:x}}}]"), F.array_join(each, "")).otherwise(s)


def int_to_char_ref(code: Column) -> Column:
    return F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))


def int_to_char_ref_hex(code: Column) -> Column:
    return F.concat(F.lit("&#x"), F.hex(code.cast("long")), F.lit(";"))


def unicode_to_xml_entity(s: Column, highest: int = 0x7F) -> Column:
    """Characters over highest as decimal references."""
    return _beyond(s, highest, lambda c: int_to_char_ref(F.ascii(c)))


def unicode_remove_none_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7f]", "")


def unicode_remove_none_latin1(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\xff]", "")


def normalize_nl(s: Column) -> Column:
    return F.regexp_replace(s, "\r\n?", "\n")


def unicode_to_utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def utf8_to_unicode(b: Column) -> Column:
    """A struct of the text, in which U+FFFD stands for bytes that are no UTF-8, and whether there were some."""
    text = F.make_valid_utf8(b.cast("string"))
    return F.struct(text.alias("text"), (~F.is_valid_utf8(b.cast("string"))).alias("bad"))


def latin1_to_unicode(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def get_decoding_fct(name: str) -> Callable[[Column], Column]:
    """Bytes of a named encoding to text; an unknown name is raised."""
    charset = NAMES[name.lower()]
    return (lambda b: utf8_to_unicode(b)["text"]) if charset == "UTF-8" else (lambda b: F.decode(b, charset))


def get_output_encoding_fct(name: str) -> Callable[[Column], Column]:
    """Text to bytes of a named encoding; what it cannot express becomes references."""
    charset = NAMES[name.lower()]
    highest = _HIGHEST.get(charset)
    return (lambda s: F.encode(s, charset)) if highest is None else (lambda s: F.encode(unicode_to_xml_entity(s, highest), charset))
