"""Packing of token sequences into windows by non-negative least squares.

Documents are cut into whole windows and a tail. Only the histogram of piece lengths (at most `window` numbers)
reaches the driver. There, shallow combinations of lengths that fill a window exactly (pairs of all lengths,
triples of the most frequent ones) are enumerated; non-negative least squares finds how often each repeats; the repeats are
rounded down, and the residual lengths are packed greedily, longest first. The plan says for each
length which ranks go to which sequences and offsets; a piece's rank is its number in its task plus the pieces of that
length in tasks before, so no length's pieces ever meet in one task.

Defined cases: a null or empty text has the end id alone. Repeated rows are packed each. An empty table gives no pieces.
Only doc_id and text are read. Ids and texts do not move; with_ids adds the pieces' ids.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Lengths that are combined to triples, the most frequent first. Others are met by pairs and the greedy rest.
TRIPLE_LENGTHS = 48


def combinations(hist: np.ndarray, window: int, common_lengths: int = TRIPLE_LENGTHS) -> list[tuple[int, ...]]:
    """Combinations of one to three of the histogram's lengths that fill a window."""
    have = np.flatnonzero(hist)
    found = {(int(n),) for n in have if n == window}
    found |= {(window - int(n), int(n)) for n in have if 2 * n <= window and n > 0 and hist[window - n]}
    top = sorted((int(n) for n in have[np.argsort(-hist[have], kind="stable")][:common_lengths] if n < window))
    for k, a in enumerate(top):
        for b in top[k:]:
            c = window - a - b
            if c > 0 and hist[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def nnls(columns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise ||A x - hist||, by multiplicative steps; A counts the lengths of each combination."""
    if not columns:
        return np.zeros(0)
    deep = max(map(len, columns))
    at = np.array([[*c, *[0] * (deep - len(c))] for c in columns])
    used = (at > 0).astype(float)
    h = hist.astype(float)
    h[0] = 0
    gather = lambda y: (y[at] * used).sum(axis=1)
    x = np.maximum(1e-9, np.min(np.where(used > 0, h[at], np.inf), axis=1) / np.maximum(1, np.bincount(at[used > 0], minlength=len(h))[at].max(axis=1)))
    goal = gather(h)
    for _ in range(rounds):
        fit = np.bincount(at.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(h))
        x *= goal / np.maximum(gather(fit), 1e-12)
    return x


def plan(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) so that every piece of the histogram (index: length) is used once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], times: float) -> None:
        need = Counter(combo)
        n = min(int(times), *(int(left[k]) // m for k, m in need.items()))
        if n > 0:
            for k, m in need.items():
                left[k] -= n * m
            out.append((combo, n))

    combos = combinations(left, window)
    x = nnls(combos, left)
    for k in np.argsort(-x, kind="stable").tolist():
        take(combos[k], x[k] + 1e-6)
    while left.any():  # each round uses a length up
        combo, space, rest = [], window, left.copy()
        while space:
            fits = np.flatnonzero(rest[: space + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            many = min(space // n, int(rest[n]))
            combo += [n] * many
            rest[n] -= many
            space -= many * n
        take(tuple(combo), int(left.sum()))
    return out


def pieces(docs: DataFrame, path: str, window: int, end: int, with_ids: bool) -> DataFrame:
    """A written table of pieces: doc_id, start, length, ids_crc32, doc_tokens, part, rank (among the task's pieces of that length)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"] + ["ids"] * with_ids

    def run(batches):
        enc, part, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                at, cols = [], [[] for _ in names[1:]]
                start, length, crc, total, parts, rank = cols[:6]
                for i, doc in enumerate(enc.documents(piece.column(1), end)):
                    for s in range(0, len(doc), window):
                        own = doc[s : s + window]
                        at.append(i), start.append(s), length.append(len(own)), crc.append(zlib.crc32(own.tobytes())), total.append(len(doc)), parts.append(part), rank.append(int(seen[len(own)]))
                        seen[len(own)] += 1
                        if with_ids:
                            cols[6].append(own.tolist())
                kinds = [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids array<long>" * with_ids
    return common.write_table(rows.mapInArrow(common.lean(run), schema), "pieces")


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    table = pieces(docs, path, window, end, with_ids)
    sizes = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = common.write_table(sizes.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "sizes")
    hist = np.zeros(window + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # window rows at most
        hist[r["length"]] = r["n"]
    low: list[list[int]] = []  # length, first rank, first sequence, offset
    ranks, sequence = np.zeros(window + 1, np.int64), 0
    for combo, times in plan(hist, window):
        at = 0
        for n in combo:
            low.append([n, int(ranks[n]), sequence, at])
            ranks[n] += times
            at += n
        sequence += times
    slots = np.array(sorted(low), np.int64).reshape(-1, 4)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        first = np.searchsorted(slots[:, 0], np.arange(window + 2))
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = first[n] + np.searchsorted(slots[first[n] : first[n + 1], 1], rank[own], "right") - 1
            cols = [*batch.columns[:5], pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3]), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = table.join(sizes.select("part", "length", "before").hint("merge"), ["part", "length"])  # grows with the tasks: no broadcast
    rows = rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"), *["ids"] * with_ids)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.lean(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)
