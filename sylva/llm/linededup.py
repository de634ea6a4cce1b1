"""Line dedup by winnowing over line hashes: runs of lines that occur earlier in the corpus are deleted.

A line's hash is that of its words, in lower case and with single spaces. A window is the shortest run of lines from a line on, or up to a
line, that has min_words words. Of each window only the smallest line hash (the leftmost of equal ones) is selected as a fingerprint. Any run of
min_words words or more that two places share holds a window, and equal windows select the same line, so both places have its fingerprint:
the guarantee of winnowing. A text has fewer fingerprints than windows the more lines a window has.

Fingerprints of all texts are counted, and only those of two positions or more go on. At each such position the match is extended both ways: to
the windows that selected it, each compared as a whole by the hash of its run with its first occurrence (doc_id, null last, then a hash of the
text, then the line). The windows from a line on extend a match to its left end, those up to a line to its right end, so what is found is
the longest run, whichever of the earlier places shares it; places are never paired, and a line that is frequent by itself matches nothing.
Lines of all later occurrences are deleted, in the same text too. Rows of one text are met once: all but the first are repeated from their first line to their last.

Defined cases: null and empty texts stay as they are; blank lines end no run and are never counted, those inside a
deleted run go with it; rows equal in doc_id and text are one document, treated alike. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line number and words of each line with a word."""
    at, hashes, size = [], [], []
    for k, line in enumerate(text.encode().split(b"\n")):
        w = line.split()
        if w:
            at.append(k)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(w).lower()))
            size.append(len(w))
    return np.array(hashes, np.uint64), np.array(at, np.int32), np.array(size, np.int32)


def windows(size: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """First line and last line + 1 of the windows of a text whose lines have `size` words."""
    cum = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    n = len(size)
    ends = np.searchsorted(cum, cum[:-1] + min_words)  # one past the last line of the window from each line on
    starts = np.searchsorted(cum, cum[1:] - min_words, "right") - 1  # first line of the window up to each line
    return sorted({(i, e) for i, e in enumerate(ends.tolist()) if e <= n} | {(s, i + 1) for i, s in enumerate(starts.tolist()) if s >= 0})


def fingerprints(hashes: np.ndarray, size: np.ndarray, min_words: int) -> dict[int, int]:
    """The selected line hashes of a text and at how many of its lines each was selected."""
    h, spans = hashes.tolist(), windows(size, min_words)
    return Counter(h[k] for k in {h.index(min(h[i:e]), i) for i, e in spans})


def matches(hashes: np.ndarray, size: np.ndarray, min_words: int, held: set[int]) -> list[tuple[int, int, int]]:
    """(hash of the run, first line, last line) of the windows that selected a fingerprint of held."""
    h, data, out = hashes.tolist(), hashes.tobytes(), []
    for i, e in windows(size, min_words):
        least = min(h[i:e])
        if least in held:
            out.append((xxhash.xxh64_intdigest(data[8 * i : 8 * e], least), i, e - 1))
    return out


def delete_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of spans (first and last line), and how many lines with a word went."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b + 1] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return "\n".join(x for x, g in zip(lines, out.tolist(), strict=True) if not g), sum(1 for x, g in zip(lines, out.tolist(), strict=True) if g and x.encode().split())


def _line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A written table of the lines and fingerprints of each text of min_words words or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "hashes", "at", "size", "keys"]

    def run(batches):
        for batch in batches:
            rows, cols = [], [[], [], [], []]
            for k, text in enumerate(batch.column(2).to_pylist()):
                hashes, at, size = lines_of(text or "")
                if size.sum() >= min_words:
                    found = fingerprints(hashes, size, min_words)
                    rows.append(k)
                    for col, v in zip(cols, (hashes.tobytes(), at.tobytes(), size.tobytes(), [(int(np.uint64(x).view(np.int64)), n) for x, n in found.items()]), strict=True):
                        col.append(v)
            take = pa.array(rows, pa.int64())
            keys = pa.array(cols[3], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.binary()) for c in cols[:3]), keys], names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return common.write_table(rows.mapInArrow(common.lean(run), f"doc_id {kind}, h long, hashes binary, at binary, size binary, keys array<struct<key:long,n:long>>"), "lines")


def repeated(docs: DataFrame, min_words: int) -> DataFrame:
    """A written table of i (an id or null), h (hash of the text) and spans of lines to delete, for each document that has some."""
    lines = _line_table(docs, min_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
    texts = lines.groupBy("h").agg(F.min(place).alias("p"), *[F.first(c).alias(c) for c in ("hashes", "at", "size", "keys")])
    texts = common.write_table(texts.select("h", F.col("p.i").alias("i"), "hashes", "at", "size", "keys"), "texts")  # one of each text

    def ends(batches):
        for batch in batches:
            at = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(x[0]) for x in at], pa.int32()), pa.array([int(x[-1]) for x in at], pa.int32())], ["i", "h", "a", "b"])

    firsts = texts.select(F.col("i").alias("_i"), F.col("h").alias("_h"))
    copies = lines.join(firsts, lines["doc_id"].eqNullSafe(firsts["_i"]) & (lines["h"] == firsts["_h"]), "left_anti").select("doc_id", "h", "at")
    copies = copies.mapInArrow(common.lean(ends), f"i {kind}, h long, a int, b int").groupBy("i", "h").agg(F.min(F.struct("a", "b")).alias("s")).select("i", "h", F.array("s").alias("spans"))

    each = texts.select("h", F.inline("keys"))
    shared = each.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("key")
    held = each.join(shared, "key").groupBy("h").agg(F.collect_list("key").alias("keys"))  # no more than the lines of a text

    def extend(batches):
        for batch in batches:
            sizes, cols = [], [[], [], []]
            for h, a, n, keys in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                at = np.frombuffer(a, np.int32)
                found = matches(np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32), min_words, set(np.array(keys, np.int64).view(np.uint64).tolist()))
                sizes.append(len(found))
                for key, x, y in found:
                    cols[0].append(key), cols[1].append(int(at[x])), cols[2].append(int(at[y]))
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(cols[0], np.uint64).view(np.int64)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["i", "h", "key", "a", "b"])

    runs = texts.drop("keys").join(held, "h").select("i", "h", "hashes", "at", "size", "keys")
    runs = common.write_table(runs.mapInArrow(common.lean(extend), f"i {kind}, h long, key long, a int, b int"), "runs")
    place = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("h").alias("h"), F.col("a").alias("a"))
    first = runs.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(F.col("f") != F.col("l")).select("key", "f")
    later = runs.join(first, "key").where(~place.eqNullSafe(F.col("f")))
    spans = later.groupBy("i", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # no more than the lines of a text, twice
    return common.write_table(spans.union(copies), "spans")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns and rows of docs, with text cut, and _deleted, the number of lines with a word that went."""
    spans = repeated(docs, min_words)
    rest, hit = common.parted(docs, spans)
    spans = spans.select(F.col("i").alias("_sylva_i"), F.col("h").alias("_sylva_h"), F.col("spans").alias("_sylva_spans"))
    rows = hit.join(spans, common.same_row(hit, spans), "left").select(*docs.columns, "_sylva_spans")
    at, last = docs.columns.index("text"), len(docs.columns)
    schema = StructType([*docs.schema.fields, StructField("_deleted", LongType())])

    def run(batches):
        for batch in batches:
            texts, count = batch.column(at).to_pylist(), [0] * batch.num_rows
            for k, own in enumerate(batch.column(last).to_pylist()):
                if own:
                    texts[k], count[k] = delete_lines(texts[k], [(x["a"], x["b"]) for x in own])
            cols = list(batch.columns[:last])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64())], [*batch.schema.names[:last], "_deleted"])

    return rest.withColumn("_deleted", F.lit(0).cast("long")).union(rows.mapInArrow(common.lean(run), schema))
