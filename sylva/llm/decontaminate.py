"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Every n-gram (four words) of a test item is a seed; one pass over all
documents finds the seeds' positions and keeps, for each document and item, the words around each cluster of
diagonals. The seeds' document counts come from these hits. A candidate with a rare seed (in at most
`rare` of the documents) or two seeds is aligned; one with a single frequent seed is aligned too where its window holds so many of
the item's words that it may reach the threshold (no loss). So the verdict on a document does not depend on its number of copies, and
a stock phrase is not aligned everywhere. Alignment scores +1 for a match and -1 for a mismatch or gap; a pair is reported if the score is at least
`threshold` of the item's length. A copy with one word in five replaced keeps a run of four words, so it has a seed.

Items shorter than n words are one seed as a whole; one of more than PART_WORDS words is cut into even parts, and aligning with a part is enough, so that
neither a block nor an alignment grows with an item. Items come in blocks of at most BLOCK_WORDS words, a size that is
counted while they are read; each block is one pass over the documents. Defined cases: items and documents that are null, empty or
without words match nothing. Repeated rows of documents give repeated pairs; equal items each give a pair. Null
ids stay null. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_WORDS = 1 << 18
PART_WORDS = 1 << 13
#: Cells of the grid of windows that are aligned at once.
GRID = 1 << 20
_WORD = np.arange(256, dtype=np.uint8)
_WORD[:128] = 32
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column and where each text's begin."""
    b, off = common.text_buffer(column)
    hs, count = [np.zeros(0, np.uint64)], np.zeros(len(off) - 1, np.int64)
    for _, _, _, _, _, h, row in common.words(_WORD[b], off):
        hs.append(h)
        count += np.bincount(row, minlength=len(count))
    return np.concatenate(hs), np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = common.mix(h[: len(h) - n + 1])
    for k in range(1, n):
        g = common.mix(g + h[k : len(h) - n + 1 + k])
    return g


class Items:
    """A block of test items with an index of their seeds."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        h, at = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.n = ids, n
        self.words, self.of = [], []  # parts, and the item that each belongs to
        for k in range(len(ids)):
            for part in np.array_split(h[at[k] : at[k + 1]], max(1, -(-int(at[k + 1] - at[k]) // PART_WORDS))):
                self.words.append(part), self.of.append(k)
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)  # items of fewer than n words, by length
        for k, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.posts[int(gram_hashes(w, len(w))[0])].append((k, 0))
            for p, g in enumerate(gram_hashes(w, n).tolist()):
                self.posts[g].append((k, p))
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.bits = np.zeros(1 << 20, bool)
        if self.posts:
            self.bits[np.array(list(self.posts), np.uint64).astype(np.int64) & 0xFFFFF] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, position in the row, seed) of all seeds in the rows' words."""
        for n in self.sizes:
            g = gram_hashes(h, n)
            pos = np.flatnonzero(self.bits[g.astype(np.int64) & 0xFFFFF])
            row = np.searchsorted(at, pos, "right") - 1
            ok = pos + n <= at[row + 1]
            for r, p, s in zip(row[ok].tolist(), pos[ok].tolist(), g[pos[ok]].tolist(), strict=True):
                if s in self.posts:
                    yield r, p - int(at[r]), s


def blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r[0]), texts.append(r[1])
        size += len(r[1] or "") // 2 + 1
        if size > BLOCK_WORDS:  # by its last item alone it may be larger
            yield Items(ids, texts, n)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, n)


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment scores of an item and each window (a row, 0 beyond its end), with the aligned words' start and end in the window."""
    b, w = windows.shape
    ramp = np.arange(w + 1, dtype=np.int32)
    h, begin = np.zeros((b, w + 1), np.int32), np.tile(ramp, (b, 1))
    best, lo, hi = np.zeros(b, np.int32), np.zeros(b, np.int32), np.zeros(b, np.int32)
    rows = np.arange(b)
    for x in item:
        new, src = np.zeros_like(h), np.tile(ramp, (b, 1))
        diag = h[:, :-1] + np.where(windows == x, 1, -1)
        up = h[:, 1:] - 1
        new[:, 1:] = np.maximum(0, np.maximum(diag, up))
        src[:, 1:] = np.where(new[:, 1:] == 0, ramp[1:], np.where(diag >= up, begin[:, :-1], begin[:, 1:]))
        lifted = new + ramp  # a gap in the item: left neighbours less their distance
        top = np.maximum.accumulate(lifted, axis=1)
        left = top - ramp
        better = left > new
        if better.any():
            where = np.maximum.accumulate(np.where(lifted == top, ramp, 0), axis=1)
            src = np.where(better, np.take_along_axis(src, where, axis=1), src)
            new = np.maximum(new, left)
        h, begin = new, src
        at = h.argmax(axis=1)
        m = h[rows, at]
        up_now = m > best
        best = np.where(up_now, m, best)
        lo, hi = np.where(up_now, begin[rows, at], lo), np.where(up_now, at, hi)
    return best, lo, hi


def most(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """An upper bound of the alignment scores of an item and each window: the item's words that occur in the window."""
    own, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    row, col = np.nonzero(own[at] == windows)
    held = np.zeros((len(windows), len(own)), bool)
    held[row, at[row, col]] = True
    return held @ times


def candidates(docs: DataFrame, items: Items) -> DataFrame:
    """A written table of clusters of hits: doc_id, hash of the text, row key, item, first word, words (window) and seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words
    names = ["doc_id", "h", "u", "item", "first", "words", "seeds"]

    def run(batches):
        items = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                piece = batch.slice(k, 2000)
                h, at = word_hashes(piece.column(3))
                by: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
                for r, p, s in items.hits(h, at):
                    for item, q in items.posts[s]:
                        by[r, item].append((p - q, p, s))
                out: list[list] = [[], [], [], [], []]
                for (r, item), hits in by.items():
                    size = len(items.words[item])
                    slack = size // 2 + 2
                    hits.sort()
                    group = [hits[0]]
                    for hit in [*hits[1:], None]:
                        if hit is not None and hit[0] - group[-1][0] <= slack and hit[0] - group[0][0] <= 2 * slack:
                            group.append(hit)
                            continue
                        lo = max(0, group[0][0] - slack)
                        hi = min(int(at[r + 1] - at[r]), group[-1][0] + size + slack)
                        for x, v in zip(out, (r, item, lo, h[at[r] + lo : at[r] + hi].tobytes(), sorted({x[2] for x in group})), strict=True):
                            x.append(v)
                        group = [hit]
                if out[0]:
                    take = pa.array(out[0], pa.int64())
                    seeds = pa.array([np.array(x, np.uint64).view(np.int64).tolist() for x in out[4]], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(piece.column(c).take(take) for c in range(3)), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), seeds], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"), "text")
    return common.write_table(rows.mapInArrow(common.lean(run), f"doc_id {kind}, h long, u long, item int, first long, words binary, seeds array<long>"), "candidates")


def _found(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, rare: float) -> DataFrame:
    """The columns of contaminated() and h, the hash of the document's text."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    total, found = None, None
    for items in blocks(benchmark, n):
        total = docs.count() if total is None else total
        rows = candidates(docs, items)
        many = rows.select("u", F.explode("seeds").alias("s")).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1.0, rare * total))
        common_seeds = frozenset(r[0] for r in many.collect())  # at most a block's seeds
        part = _aligned(rows, items, common_seeds, threshold, item_kind)
        found = part if found is None else found.union(part)
    schema = f"doc_id {kind}, h long, item_id {item_kind}, score double, first_word long, end_word long"
    return common.small_table(docs.sparkSession, schema, [[]] * 6) if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.6, rare: float = 0.001) -> DataFrame:
    """doc_id, item_id, score (share of the item's length), first_word and end_word (of the document's words) for each document and item that align."""
    return _found(docs, benchmark, n, threshold, rare).drop("h")


def _aligned(rows: DataFrame, items: Items, common_seeds: frozenset, threshold: float, item_kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((items, common_seeds))

    def run(batches):
        items, frequent = shared.value
        for batch in batches:
            doc, text, key, item, first, words, seeds = (batch.column(k) for k in range(7))
            item, first, words = item.to_pylist(), first.to_pylist(), words.to_pylist()
            groups: dict[tuple[int, int, bool], list[int]] = defaultdict(list)
            for k, s in enumerate(seeds.to_pylist()):
                sure = len(s) > 1 or s[0] not in frequent or len(items.words[item[k]]) <= items.n
                groups[item[k], -(-len(words[k]) // 256), sure].append(k)
            best: dict[tuple, tuple] = {}
            keys = key.to_pylist()
            for (i, size, sure), own in groups.items():
                wide = size * 32
                step = max(1, min(256, GRID // wide))
                for c in range(0, len(own), step):
                    part = own[c : c + step]
                    grid = np.zeros((len(part), wide), np.uint64)
                    for k, x in enumerate(part):
                        w = np.frombuffer(words[x], np.uint64)
                        grid[k, : len(w)] = w
                    if not sure:
                        may = np.flatnonzero(most(items.words[i], grid) >= threshold * len(items.words[i]) - 1e-9)
                        part, grid = [part[k] for k in may.tolist()], grid[may]
                        if not part:
                            continue
                    score, lo, hi = align(items.words[i], grid)
                    score = score / len(items.words[i])
                    for k in np.flatnonzero(score >= threshold - 1e-9).tolist():
                        x = part[k]
                        new = (float(score[k]), -(first[x] + int(lo[k])), -(first[x] + int(hi[k])), x)
                        if new > best.get((keys[x], items.of[i]), (0,)):
                            best[keys[x], items.of[i]] = new
            if best:
                hit = list(best.items())
                take = pa.array([v[3] for _, v in hit], pa.int64())
                cols = [*(c.take(take) for c in (doc, text, key)), pa.array([i for (_, i), _ in hit], pa.int32()), pa.array([v[0] for _, v in hit])]
                cols += [pa.array([-v[k] for _, v in hit], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "u", "item", "score", "first_word", "end_word"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(common.lean(run), f"doc_id {kind}, h long, u long, item int, score double, first_word long, end_word long")
    # clusters of one document and item may lie in two batches: the best stays
    top = found.groupBy("u", "doc_id", "h", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), (-F.col("end_word")).alias("e"))).alias("b"))
    spark = rows.sparkSession
    names = common.small_table(spark, f"item int, item_id {item_kind}", [list(range(len(items.ids))), items.ids])
    joined = top.join(F.broadcast(names), "item")  # a block's items
    return joined.select("doc_id", "h", "item_id", F.col("b.score").alias("score"), (-F.col("b.f")).alias("first_word"), (-F.col("b.e")).alias("end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.6, rare: float = 0.001) -> DataFrame:
    """The documents that align with no test item, with all their columns. Rows of one id, or of none, are told apart by their texts."""
    bad = common.write_table(_found(docs, benchmark, n, threshold, rare).select(F.col("doc_id").alias("i"), "h").distinct(), "bad")
    rest, hit = common.parted(docs, bad)
    bad = bad.select(F.col("i").alias("_sylva_i"), F.col("h").alias("_sylva_h"))
    return rest.union(hit.join(bad, common.same_row(hit, bad), "left_anti").select(*docs.columns))
