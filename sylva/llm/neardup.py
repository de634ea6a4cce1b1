"""Near-duplicate groups of the pipeline: all pairs of texts whose shingle sets have a Jaccard similarity of at least `least`.

An exact set join. Two sets that similar share a shingle among the first n - ceil(least * n) + 1 of each, in any
order that both use; the order here is by hash, with shingles that are frequent in a bounded sample last, so that the sample
bears on the cost alone. Within a bucket of one shingle, sets are compared by size and by a parity map of about a bit a shingle, 512 to 4096 (the maps
differ in no more bits than the sets in shingles: no loss); what passes are clusters, and equal clusters of several
buckets are one. Only then do the whole sets come, those of clusters alone, and the similarity is verified. Within buckets and clusters a
search takes out what it reaches, so a large group of copies is met once, and links are a spanning forest, never pairs.
A group is a connected component. Equal sets are one node.

With max_bits, SimHash links sets as well: each set has a 64-bit fingerprint by the majority of its shingles' hashes, and those that differ in
max_bits at most are found by operator 10's blocks and pivot distance tables. These links and those of the set join are one graph, as SimHash alone loses
most pairs of similarity 0.8 (about ten bits apart).

Defined cases: texts without words have an empty set and are alike. Fewer words than a shingle: the whole word sequence is
the shingle. Words are in lower case (ASCII), split at ASCII white space. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .decontaminate import gram_hashes

SAMPLE = 20_000
FREQUENT = 4
BITS = (512, 4096)
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    b, off = common.text_buffer(column)
    hs, count = [np.zeros(0, np.uint64)], np.zeros(len(off) - 1, np.int64)
    for *_, h, row in common.words(b, off, True):
        hs.append(h)
        count += np.bincount(row, minlength=len(count))
    h, at = np.concatenate(hs), np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    g = gram_hashes(h, words)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(g[s : e - words + 1]) if e - s >= words else gram_hashes(h[s:e], e - s) if e > s else np.zeros(0, np.uint64)


def prefix(own: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a set that are dealt to buckets; those in last (sorted) come after the others."""
    if not len(own):
        return own
    if len(last):
        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
        own = np.concatenate((own[~late], own[late]))
    return own[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]


def parity(own: np.ndarray) -> bytes:
    """For each value of the shingles' lower bits, whether their number is odd."""
    width = min(max(BITS[0], 1 << (len(own) - 1).bit_length()), BITS[1]) if len(own) else BITS[0]
    odd = (np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set, as a signed long: a bit is one where more than half of the shingles' hashes have it; zero for an empty set."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(own), PIECE):
        count += np.unpackbits(own[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(own)).view(np.int64)[0])


class Maps:
    """Parity maps of several widths; two are compared at the lesser width, to which the other is folded."""

    def __init__(self, maps: list[bytes], n: np.ndarray, least: float):
        self.n, self.least = n, least
        self.width = np.array([8 * len(x) for x in maps], np.int64)
        self.at, self.maps = {}, {}
        for w in np.unique(self.width).tolist():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            grid = np.frombuffer(b"".join(maps[k] for k in own.tolist()), np.uint64).reshape(len(own), -1)
            if len(twice):
                wide = np.frombuffer(b"".join(maps[k] for k in twice.tolist()), np.uint64).reshape(len(twice), 2, -1)
                grid = np.concatenate((grid, wide[:, 0] ^ wide[:, 1]))
            self.at[w] = np.zeros(len(maps), np.int64)
            self.at[w][np.concatenate((own, twice))] = np.arange(len(grid))
            self.maps[w] = grid

    def may(self, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        """Which pairs may be similar. Sets of similar sizes have widths that are equal or double."""
        x = np.broadcast_to(x, y.shape)
        small, large = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        ok = small >= self.least * large - 1e-9
        k = np.flatnonzero(ok)
        width = np.minimum(self.width[x[k]], self.width[y[k]])
        for w in np.unique(width).tolist():
            own = k[width == w]
            at, maps = self.at[w], self.maps[w]
            apart = np.bitwise_count(maps[at[x[own]]] ^ maps[at[y[own]]]).sum(axis=1, dtype=np.int64)
            ok[own] = apart <= (1 - self.least) / (1 + self.least) * (small[own] + large[own]) + 1e-9
        return ok


def _signature(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def clusters_of(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[list[int], list[int]]]:
    """Connected members of 0 .. n - 1, two at least, and the one from which each was reached; near(x, others) tells which of the others are linked to x."""
    left = np.arange(n)
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        found, via = todo[:], todo[:]
        while todo and len(left):
            x = todo.pop()
            ok = near(x, left)
            new = left[ok].tolist()
            left = left[~ok]
            todo += new
            found += new
            via += [x] * len(new)
        if len(found) > 1:
            yield found, via


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of several documents of a bounded sample."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), words))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["s"])

    total = docs.count()
    some = docs.select("text").sample(min(1.0, SAMPLE / max(total, 1)), 1).mapInArrow(common.lean(run), "s long")
    rows = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).select("s").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def shingle_table(docs: DataFrame, words: int, least: float) -> DataFrame:
    """A written table of doc_id, h (a hash of the text), sig (a hash of the set), fp (its fingerprint), n (its size), bits (its parity map) and prefix."""
    last = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sig, fp, n, bits, first = [], [], [], [], []
            for own in shingle_sets(batch.column(2), words):
                sig.append(_signature(own)), fp.append(fingerprint(own)), n.append(len(own)), bits.append(parity(own))
                first.append(prefix(own, last.value, least).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in first]))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), lists], ["doc_id", "h", "sig", "fp", "n", "bits", "prefix"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return common.write_table(rows.mapInArrow(common.lean(run), f"doc_id {kind}, h long, sig long, fp long, n long, bits binary, prefix array<long>"), "shingles")


def _shared(table: DataFrame) -> DataFrame:
    """A written table of (s, sig): the shingles of prefixes that several sets hold."""

    def run(batches):
        for rows, _ in common.runs(batches):
            s, sig = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            once = np.concatenate(([True], (s[1:] != s[:-1]) | (sig[1:] != sig[:-1])))  # equal sets are one
            s, sig = s[once], sig[once]
            same = s[1:] == s[:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(sig[keep])], ["s", "sig"])

    dealt = table.select(F.explode("prefix").alias("s"), "sig").repartition("s").sortWithinPartitions("s", "sig")
    return common.write_table(dealt.mapInArrow(common.lean(run), "s long, sig long"), "shared")


def _clusters(table: DataFrame, least: float) -> DataFrame:
    """A written table of (cluster, sig): sets that share a shingle of their prefixes and may be similar by size and parity map."""
    def run(batches):
        for rows, at in common.runs(batches):
            sig, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            may = Maps(rows.column(3).to_pylist(), n, least).may
            mixed = common.mix(sig.view(np.uint64))
            size = np.diff(at)
            two = at[:-1][size == 2]  # most buckets
            two = two[may(two, two + 1)]
            keys, own = [np.repeat(common.mix(mixed[two] + mixed[two + 1]), 2)], [np.stack((two, two + 1), axis=1).ravel()]
            for s, m in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for found, _ in clusters_of(m, lambda x, y, s=s: may(s + x, s + y)):
                    k = s + np.array(found)
                    keys.append(np.repeat(common.mix(mixed[k].sum(keepdims=True)), len(k)))
                    own.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(sig[np.concatenate(own)])], ["cluster", "sig"])

    maps = table.select("sig", "n", "bits").dropDuplicates(["sig"])
    dealt = _shared(table).join(maps, "sig").select("s", "sig", "n", "bits").repartition("s").sortWithinPartitions("s")
    return common.write_table(dealt.mapInArrow(common.lean(run), "cluster long, sig long").distinct(), "clusters")


def _sets(docs: DataFrame, clusters: DataFrame, words: int) -> DataFrame:
    """(sig, own): the sets in clusters; a bit filter of FILTER bits passes over most others before anything is dealt."""
    bit = F.col("sig").bitwiseAND(common.FILTER - 1)
    held = clusters.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("b")).collect()  # at most common.FILTER / 64 rows
    mask = np.zeros(common.FILTER // 64, np.int64)
    for w, b in held:
        mask[w] = b
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        mask = shared.value.view(np.uint64)
        for batch in batches:
            sig, sets = [], []
            for own in shingle_sets(batch.column(0), words):
                k = _signature(own)
                if int(mask[(k & (common.FILTER - 1)) >> 6]) >> (k & 63) & 1:
                    sig.append(k), sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(sets, pa.binary())], ["sig", "own"])

    return docs.select("text").mapInArrow(common.lean(run), "sig long, own binary").dropDuplicates(["sig"])


def links(docs: DataFrame, table: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (u, v) between signatures of similar sets: a spanning forest of each cluster."""

    def run(batches):
        for rows, at in common.runs(batches):
            sig = rows.column(1).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column(2).to_pylist()]
            n = np.array([len(x) for x in sets])
            us, vs = [], []

            def near(x, y):
                both = np.array([len(np.intersect1d(sets[x], sets[k], assume_unique=True)) for k in y.tolist()])
                return both >= least * (n[x] + n[y] - both) - 1e-9

            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for found, via in clusters_of(e - s, lambda x, y, s=s: near(s + x, s + y)):
                    us += [s + x for x in found[1:]]
                    vs += [s + x for x in via[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(sig[us] if us else [], pa.int64()), pa.array(sig[vs] if vs else [], pa.int64())], ["u", "v"])

    clusters = _clusters(table, least)
    dealt = clusters.join(_sets(docs, clusters, words), "sig").select("cluster", "sig", "own").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(common.lean(run), "u long, v long")


def simhash_links(table: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) between signatures of sets whose fingerprints differ in max_bits at most; of the sets of one fingerprint, the first stands for it."""
    first = common.write_table(table.groupBy("fp").agg(F.min("sig").alias("first"), F.max("sig").alias("last")), "fingerprints")
    several = first.where("first < last").select("fp", "first")
    same = table.join(several, "fp").where("sig > first").select(F.col("sig").alias("u"), F.col("first").alias("v"))
    near = simhash.links(first.select("fp"), max_bits)
    near = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.union(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """One row of each group, that of the smallest id (a null id comes last), with all its columns. max_bits: that of SimHash links, which then count too."""
    table = shingle_table(docs, words, least)
    first = table.groupBy("sig").agg(F.min(simhash.place()).alias("k"))
    edges = links(docs, table, words, least)
    if max_bits is not None:
        edges = edges.union(simhash_links(table, max_bits))
    roots = components(edges).select(F.col("node").alias("sig"), "root")
    return simhash.rows_at(docs, table, first.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("component")).agg(F.min("k").alias("k")))
