"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints are 64 bits over XXH64 of word shingles. Distinct fingerprints within max_bits = 2 are linked, and a
group is a connected component. Two such fingerprints agree in two of four 16-bit blocks, so each distinct
fingerprint goes to six buckets keyed by a pair of blocks. Within a bucket, a table of Hamming distances to many fixed pivot
fingerprints discards pairs whose largest coordinate difference exceeds max_bits (the triangle inequality: no
loss), the rest are verified, and only a spanning forest of the links leaves the bucket. A bucket that is too
large is dealt again by pairs of 8-bit blocks of its other 32 bits, so that no table exceeds 65,536 fingerprints.
Exact copies share one fingerprint and never meet pairwise.

Defined cases: null, empty and white-space texts have fingerprint zero, which links like any other. Fewer words
than a shingle: the whole word sequence is the shingle. Repeated rows each give a row. Null ids are passed over
when the smallest id is sought. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Reference fingerprints of the distance tables.
PIVOTS = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, 32, dtype=np.uint64)
_PAIRS = tuple(combinations(range(4), 2))
TABLE = 1 << 11


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    w = text.lower().split()
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), seed)] if w else []
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip([0, *(e + 1 for e in ends)], ends[words - 1 :], strict=False)]


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """A fingerprint for each text; a bit is set where more than half of the shingle hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    sizes: list[int] = []
    rows: list[int] = []

    def settle() -> None:
        if not rows:
            return
        bits = np.unpackbits(np.array(held, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n = np.array(sizes)
        count = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * count > n[:, None], axis=1).view(">u8").ravel()
        held.clear(), sizes.clear(), rows.clear()

    for k, text in enumerate(texts):
        if text and (h := shingle_hashes(text.encode(), words)):
            if len(h) > 1 << 20:  # a very long text: its bits are counted in pieces
                count = sum(np.unpackbits(np.array(h[i : i + (1 << 18)], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), 1 << 18))
                out[k] = np.packbits(2 * count > len(h)).view(">u8")[0]
                continue
            held.extend(h)
            sizes.append(len(h))
            rows.append(k)
            if len(held) > 1 << 17:
                settle()
    settle()
    return out


def fingerprint_table(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, h (a hash of the text that tells rows of one id apart) and fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            fp = fingerprints(batch.column(2).to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(common.lean(run), f"doc_id {kind}, h long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Joins a[i] and b[i] in the forest root."""
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)


def _linked(fp: np.ndarray, table: np.ndarray, max_bits: int, root: list[int], at: np.ndarray) -> None:
    """Joins the linked fingerprints of one bucket; the first pivot's distance orders them, and only a band around it is compared."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table, at = fp[order], table[order], at[order]
    last = np.searchsorted(table[:, 0], table[:, 0].astype(np.int64) + max_bits, "right")
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, last[i])
        for lo in (1, 4, 12):
            if not len(j):
                break
            hi = {1: 4, 4: 12, 12: table.shape[1]}[lo]
            j = j[np.abs(table[j, lo:hi].astype(np.int16) - table[i, lo:hi].astype(np.int16)).max(axis=1) <= max_bits]
        if len(j):
            j = j[np.bitwise_count(fp[j] ^ fp[i]) <= max_bits]
            _roots(len(fp), np.full(len(j), at[i]), at[j], root)


def bucket_links(fp: np.ndarray, key_pair: int, max_bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the distinct fingerprints of one bucket."""
    root = list(range(len(fp)))
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :])
    if len(fp) <= TABLE:
        _linked(fp, table, max_bits, root, np.arange(len(fp)))
    else:
        rest = [k for k in range(4) if k not in _PAIRS[key_pair]]
        blocks = [(fp >> np.uint64(16 * k + s)) & np.uint64(255) for k in rest for s in (0, 8)]
        for x, y in _PAIRS:
            key = (blocks[x] << np.uint64(8)) | blocks[y]
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cut):
                if len(part) > 1:
                    _linked(fp[part], table[part], max_bits, root, part)
    top = np.array([_find(root, k) for k in range(len(fp))])
    own = np.flatnonzero(top != np.arange(len(fp)))
    return fp[own], fp[top[own]]


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        x = root[x]
    return x


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (u, v), no more than the members of a bucket, between distinct fingerprints (column fp) within max_bits (2 at most)."""
    if max_bits > 2:
        raise ValueError("two of four blocks agree only up to 2 differing bits")
    keys = [F.lit(n << 32) + F.shiftrightunsigned("fp", 16 * x).bitwiseAND(65535) * 65536 + F.shiftrightunsigned("fp", 16 * y).bitwiseAND(65535) for n, (x, y) in enumerate(_PAIRS)]
    dealt = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for rows, at in common.runs(batches):
            key, fp = rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64)
            start, size = at[:-1], np.diff(at)
            two = start[size == 2]  # most buckets hold one or two
            x, y = fp[two], fp[two + 1]
            ok = np.abs(np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int16) - np.bitwise_count(y[:, None] ^ PIVOTS)).max(axis=1, initial=0) <= max_bits
            ok &= np.bitwise_count(x ^ y) <= max_bits
            us, vs = [x[ok]], [y[ok]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                u, v = bucket_links(fp[s : s + n], int(key[s] >> 32), max_bits)
                us.append(u), vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(common.lean(run), "u long, v long")


def groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, h, fp and component (a signed long that all documents of a group share) for every document."""
    table = common.write_table(fingerprint_table(docs, words), "fingerprints")
    roots = components(links(table.select("fp").distinct(), max_bits))
    return table.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("doc_id", "h", "fp", F.coalesce("root", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the group's smallest doc_id) for every document.

    The smallest ids are sought by fingerprint, then by component of distinct fingerprints; both tables are written, so that the joins can split a large group.
    """
    table = common.write_table(fingerprint_table(docs, words), "fingerprints")
    least = table.groupBy("fp").agg(F.min("doc_id").alias("i"))
    roots = components(links(table.select("fp").distinct(), max_bits)).select(F.col("node").alias("fp"), "root")
    own = common.write_table(least.join(roots, "fp", "left").select("fp", "i", F.coalesce("root", "fp").alias("component")), "components")
    first = common.write_table(own.groupBy("component").agg(F.min("i").alias("component_id")), "least")
    named = common.write_table(own.join(first, "component").select("fp", "component_id"), "named")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def place() -> Column:
    """What orders the rows of a table with doc_id and h: the id, a null one last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("h").alias("h"))


def rows_at(docs: DataFrame, table: DataFrame, kept: DataFrame) -> DataFrame:
    """A row of docs for each k (a place) of kept, with all its columns. table: doc_id and h of every row of docs. Groups may share an id or have none, so both tell rows apart."""
    kept = kept.select(F.col("k.i").alias("_i"), F.col("k.h").alias("_h"), F.lit(True).alias("keep"))
    rows = table.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_i"]) & (rows["h"] == kept["_h"]), "left")
    odd = common.write_table(rows.where(F.col("keep").isNull() | (F.col("c") > 1)).select(F.col("doc_id").alias("i"), "h", "keep"), "odd")  # rows that go or repeat
    rest, hit = common.parted(docs, odd)
    odd = odd.select(F.col("i").alias("_sylva_i"), F.col("h").alias("_sylva_h"), F.coalesce("keep", F.lit(False)).alias("_sylva_keep"))
    hit = hit.join(odd, common.same_row(hit, odd), "left").where(F.coalesce("_sylva_keep", F.lit(True))).dropDuplicates(["doc_id", "_sylva_x"])
    return rest.union(hit.select(*docs.columns))


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group, that of the smallest id (a null id comes last), with all its columns."""
    found = common.write_table(groups(docs, words, max_bits), "groups")
    return rows_at(docs, found, found.groupBy("component").agg(F.min(place()).alias("k")))
