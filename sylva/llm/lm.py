"""Language-model scoring by deleted interpolation of bigrams.

P(w | u) = l(c(u)) c(u, w) / c(u) + (1 - l(c(u))) P1(w), and P1(w) = m c(w) / N + (1 - m) / (V + 1). The weight l
depends on the bucket (power of two) of the context's count. Weights are learned by expectation-maximisation on the counts of
training documents that are held out of the estimates for this purpose (one in `deleted`); then all training documents count.
A text's end is a token, and the context of a text's first word.

Counts never leave the executors as a whole; they are exact but for words or bigrams whose hashes are equal, which count as one. Documents come in chunks of about CHUNK tokens, each with its
distinct words and bigrams as sorted 64- and 56-bit hashes (so of 10^9 distinct bigrams one in 7 * 10^7 shares its hash with another). Shards of the hash range sum the chunks' counts
and answer each chunk with the corpus's counts of what it asked for; so what moves is one entry a distinct bigram of a chunk, with no row
for each token, and a hot word is one entry a chunk. Only histograms of bounded size reach the driver.

Defined cases: a null or empty text is its end alone. Repeated rows count and are scored each. Without training
documents all probabilities are 1 (V = 0). Ids must be whole numbers or null. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 20
#: Tokens whose probabilities are computed at once.
SLICE = 1 << 17
#: Values of a cell at most, so that neither Spark nor Parquet makes arrays of half a megabyte or more: those G1 lays out by themselves, and it takes more heap rather than collect.
PIECE = 1 << 15
#: Keys of a shard that are summed at once.
SUM = 1 << 19
#: Bytes of an Arrow batch that a worker gets, and of the cells that it returns at once.
BATCH, BACK = 1 << 20, 1 << 18
END = np.uint64(0x5EED0FE0D0C5E4D1)
#: Bins an octave of the likelihoods whose counts EM sees.
FINE = 8


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, least first."""
    size = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, np.uint64), dtype=np.uint64)


def bigrams(t: np.ndarray) -> np.ndarray:
    """56-bit hashes of each token with the one before it."""
    out = np.empty(len(t), np.uint64)
    for k in range(0, len(t), SLICE):
        own = t[k : k + SLICE]
        before = np.concatenate((t[k - 1 : k] if k else np.array([END]), own[:-1]))
        out[k : k + SLICE] = common.mix(common.mix(before) + own) >> np.uint64(8)
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them; as np.unique, with less memory."""
    order = np.argsort(x)
    x = x[order]
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return x[first], place


#: Columns of a chunk's rows, of PIECE values each; part: 0 words, 1 bigrams (keys and training counts), 2 place of each token's word by
#: frequency, 3 words by frequency, 4 documents (sizes, ids, whether the id is null and whether it counts).
ROW = "chunk long, em boolean, part int, piece int, a binary, b binary, c binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema of whole numbers, booleans and bytes as an Arrow batch."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def chunk_rows(chunk: int, em: bool, t: np.ndarray, size: np.ndarray, train: np.ndarray, ids: list) -> Iterator[tuple]:
    """The rows of a chunk: t holds the tokens of documents of `size` tokens, those of `train` count."""
    learn = np.repeat(train, size)

    def cut(n):
        return enumerate(slice(k, k + PIECE) for k in range(0, n, PIECE))

    def counted(part, keys, place):
        count = np.bincount(place[learn], minlength=len(keys)).astype(np.uint32)
        for k, own in cut(len(keys)):
            yield chunk, em, part, k, pack_keys(keys[own]), pack_ints(count[own]), None

    keys, place = distinct(t)
    yield from counted(0, keys, place)
    rank = np.argsort(-np.bincount(place, minlength=len(keys)), kind="stable").astype(np.uint32)
    of = np.empty(len(keys), np.uint32)
    of[rank] = np.arange(len(keys), dtype=np.uint32)
    for k, own in cut(len(t)):
        yield chunk, em, 2, k, pack_ints(of[place[own]]), None, None
    for k, own in cut(len(rank)):
        yield chunk, em, 3, k, pack_ints(rank[own]), None, None
    null = np.array([x is None for x in ids], np.uint8)
    whole = np.array([x or 0 for x in ids], np.int64)
    for k, own in cut(len(ids)):
        yield chunk, em, 4, k, pack_ints(size[own].astype(np.uint64)), whole[own].tobytes(), null[own].tobytes() + train[own].astype(np.uint8).tobytes()
    del keys, place, rank, of
    yield from counted(1, *distinct(bigrams(t)))


def chunks(docs: DataFrame, train: Column, deleted: int) -> DataFrame:
    """A written table of chunks; those with em hold training documents set aside for EM."""

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {em: [[], [], [], [], 0] for em in (False, True)}

        def settle(em: bool):
            nonlocal made
            t, size, learn = (np.concatenate(x) for x in held[em][:3])
            ids = held[em][3]
            held[em] = [[], [], [], [], 0]
            made += 1
            for row in chunk_rows(base + made - 1, em, t, size, learn, ids):
                yield batch_of([row], ROW)

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                b, off = common.text_buffer(piece.column(1))
                n, hs, count = len(off) - 1, [], np.zeros(len(off) - 1, np.int64)
                for _, _, _, _, _, h, row in common.words(b, off, lower=True, size=SLICE << 2):
                    hs.append(h)
                    count += np.bincount(row, minlength=n)
                t = np.insert(np.concatenate([np.zeros(0, np.uint64), *hs]), np.cumsum(count), END)
                size = count + 1
                learn = np.array(piece.column(2).to_pylist(), bool)
                aside = np.array(piece.column(3).to_pylist(), bool) & learn
                ids = piece.column(0).to_pylist()
                for em in (False, True):
                    own = aside == em
                    if own.any():
                        to = held[em]
                        to[0].append(t[np.repeat(own, size)]), to[1].append(size[own]), to[2].append(learn[own])
                        to[3].extend(x for x, o in zip(ids, own.tolist(), strict=True) if o)
                        to[4] += int(size[own].sum())
                        if to[4] >= CHUNK:
                            yield from settle(em)
        for em in (False, True):
            if held[em][4]:
                yield from settle(em)

    aside = F.pmod(F.xxhash64("doc_id"), F.lit(deleted)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"), aside.alias("aside"))
    return common.write_table(rows.mapInArrow(common.lean(run), ROW), "chunks", common.WIDE, BATCH)


def even_keys(spark, parts: int, each: int) -> np.ndarray:
    """For each of parts partitions, `each` integers that Spark's hash deals to it, so that every partition gets one shard of each kind."""
    key = F.col("id").cast("int")
    rows = spark.range(0, 64 * each * parts).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("p")).agg(F.slice(F.array_sort(F.collect_list(key)), 1, each).alias("k")).orderBy("p")
    return np.array([r["k"] for r in rows.collect()], np.int64)  # as many as partitions


def answers(table: DataFrame, shards: int) -> DataFrame:
    """A written table: for each chunk, part and shard the corpus's counts of its keys, in the order of `at`, without (a) and with (b) documents set aside; and, as chunk -1, sums."""

    names_of = even_keys(table.sparkSession, shards, 2)
    sent = "shard int, chunk long, em boolean, part int, at long, a binary, b binary"
    back = "chunk long, part int, at long, a binary, b binary"

    def deal(batches):
        for batch in batches:
            for chunk, em, part, piece, keys, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, count = unpack_keys(keys), unpack_ints(count, np.uint32)
                top = keys >> np.uint64(32 if part == 0 else 24)
                shard = (top * np.uint64(shards)) >> np.uint64(32)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                rows = []
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(int(cut[s]), int(cut[s + 1]))
                    rows.append((int(names_of[s, part]), chunk, em, part, piece * shards + s, pack_keys(keys[own]), pack_ints(count[own])))
                yield batch_of(rows, sent)

    dealt = table.where(F.col("part") < 2).select("chunk", "em", "part", "piece", "a", "b").mapInArrow(common.lean(deal), sent)

    def settle(rows: list[tuple]):
        """The answers to rows of one part and shard; rows is emptied."""
        part = rows[0][2]
        head = [(x[0], x[1], x[3]) for x in rows]
        keys = [unpack_keys(x[4]) for x in rows]
        count = [unpack_ints(x[5], np.uint32) for x in rows]
        rows.clear()
        steps = sum(map(len, keys)) // SUM + 1
        low, high = min(int(x[0]) for x in keys), max(int(x[-1]) for x in keys)
        edges = np.array([low + (high - low) * k // steps for k in range(1, steps)], np.uint64)
        cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in keys]
        every = [np.empty(len(x), np.uint64) for x in keys]
        main = [np.empty(len(x), np.uint64) if em else None for x, (_, em, _) in zip(keys, head, strict=True)]
        sums = np.zeros(4)
        for k in range(steps):
            own = [(i, slice(c[k], c[k + 1])) for i, c in enumerate(cuts) if c[k] < c[k + 1]]
            if not own:
                continue
            whole, place = distinct(np.concatenate([keys[i][x] for i, x in own]))
            n = np.concatenate([count[i][x] for i, x in own])
            with_aside = np.bincount(place, weights=n, minlength=len(whole))
            n[np.repeat([head[i][1] for i, _ in own], [x.stop - x.start for _, x in own])] = 0
            without = np.bincount(place, weights=n, minlength=len(whole))
            sums += ((with_aside > 0).sum(), with_aside.sum(), (without > 0).sum(), without.sum())
            at = 0
            for i, x in own:
                to = place[at : at + x.stop - x.start]
                every[i][x] = with_aside[to]
                if main[i] is not None:
                    main[i][x] = without[to]
                at += len(to)
        keys.clear(), count.clear()
        if part == 0:
            yield -1, 0, 0, sums.tobytes(), None
        for i, (chunk, _, at) in enumerate(head):
            yield chunk, part, at, None if main[i] is None else pack_ints(main[i]), pack_ints(every[i])
            main[i] = every[i] = None

    def total(batches):
        held = defaultdict(list)  # by part and shard: a partition has one shard of each part
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[row[0]].append(row[1:])
        while held:
            out, size = [], 0
            for row in settle(held.popitem()[1]):
                out.append(row)
                size += sum(len(x) for x in row[3:] if x is not None)
                if size >= BACK:
                    yield batch_of(out, back)
                    out, size = [], 0
            if out:
                yield batch_of(out, back)

    return common.write_table(dealt.repartition(shards, "shard").mapInArrow(common.lean(total), back), "answers", common.WIDE, BATCH)


class Chunk:
    """A chunk with the counts it was answered."""

    def __init__(self, rows: list[tuple]):
        """rows: (part, place among the part's rows, a, b, c); a counts' row has part + 10. rows is emptied."""
        of = defaultdict(list)
        for r in sorted(rows, key=lambda r: r[:2]):
            of[r[0]].append(r[2:])
        rows.clear()

        def whole(part, kind, col=0):
            return np.concatenate([unpack_ints(x[col], kind) for x in of[part]])

        keys = np.concatenate([unpack_keys(x[0]) for x in of.pop(0)])
        self.id = whole(3, np.uint32).astype(np.int32)[whole(2, np.uint32)]  # place of each token's word among the keys
        self.size = whole(4, np.uint64).astype(np.int64)
        null, flags = np.concatenate([np.frombuffer(x[2], np.uint8).reshape(2, -1) for x in of[4]], axis=1)
        self.doc_ids = pa.array(np.frombuffer(b"".join(x[1] for x in of[4]), np.int64), mask=null.astype(bool))
        self.train = flags.astype(bool)
        self.end = int(np.searchsorted(keys, END))
        self.answers = {}
        for part in (0, 1):
            for col in (0, 1):
                self.answers[part, col] = None if any(x[col] is None for x in of[part + 10]) else whole(part + 10, np.uint64, col).astype(np.float64)
        of.clear()
        self.bigram = distinct(bigrams(keys[self.id]))[1]

    def counts(self, aside: bool):
        """For slices of the tokens: where they begin, and the counts of each token's context, of the token and of both; with aside, without the documents set aside."""
        uni, bi = self.answers[0, 0 if aside else 1], self.answers[1, 0 if aside else 1]
        for k in range(0, len(self.id), SLICE):
            own = self.id[k : k + SLICE]
            context = np.concatenate(([self.id[k - 1] if k else self.end], own[:-1]))
            yield k, uni[context], uni[own], bi[self.bigram[k : k + SLICE]]


def by_chunk(table: DataFrame, answered: DataFrame, em_only: bool, run, schema: str) -> DataFrame:
    """Applies run to each chunk."""
    own = table.where(F.col("part") != 1)
    if em_only:
        own = own.where("em")
        answered = answered.join(own.where("part = 4 and piece = 0").select("chunk"), "chunk", "left_semi")
    none = F.lit(None).cast("binary")
    words = F.col("part") == 0
    own = own.select("chunk", "part", F.col("piece").cast("long").alias("at"), "a", F.when(words, none).otherwise(F.col("b")).alias("b"), "c")
    back = answered.where("chunk >= 0").select("chunk", (F.col("part") + 10).alias("part"), "at", "a", "b", none.alias("c"))
    rows = own.union(back).repartition("chunk").sortWithinPartitions("chunk")

    def each(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != at:
                    yield from run(Chunk(held))
                    held = []
                    pa.default_memory_pool().release_unused()
                at = row[0]
                held.append(row[1:])
        if held:
            yield from run(Chunk(held))

    return rows.mapInArrow(common.lean(each), schema)


def mixture(p: np.ndarray, q: np.ndarray, n: np.ndarray, rounds: int = 100) -> float:
    """The weight of p against q that makes events, seen n times, likeliest: EM."""
    if not n.sum():
        return 0.5
    x = 0.5
    for _ in range(rounds):
        x = float((n * x * p / (x * p + (1 - x) * q)).sum() / n.sum())
    return min(max(x, 1e-6), 1 - 1e-6)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the count's power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learn(table: DataFrame, answered: DataFrame, n: float, v: float) -> tuple[float, np.ndarray]:
    """Weight of the unigram against the uniform estimate, and of the bigram by bucket, from the documents set aside."""
    names = ["k", "x", "y", "n"]

    def run(chunk: Chunk):
        size = lambda x: np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * FINE), 1).astype(np.int64)
        for _, context, word, both in chunk.counts(True):
            key = (bucket(context) << 40) | ((size(both / np.maximum(context, 1)) + 4096) << 20) | (size(word / max(n, 1)) + 4096)
            keys, times = np.unique(key, return_counts=True)
            cols = (keys >> 40, ((keys >> 20) & 0xFFFFF) - 4096, (keys & 0xFFFFF) - 4096, times)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    bins = common.write_table(by_chunk(table, answered, True, run, "k long, x long, y long, n long").groupBy("k", "x", "y").agg(F.sum("n").alias("n")), "bins", batch=BATCH)
    rows = bins.toArrow()  # bins, whatever the corpus's size
    k, x, y, times = (rows.column(c).to_numpy() for c in range(4))
    p = lambda z: np.where(z > 0, 0.0, 2.0 ** (np.minimum(z, 0) / FINE))
    uniform = np.full(len(times), 1 / (v + 1))
    m = mixture(p(y), uniform, times)
    base = m * p(y) + (1 - m) / (v + 1)
    weights = np.zeros(66)
    for b in range(1, 66):
        own = k == b
        weights[b] = mixture(p(x[own]), base[own], times[own]) if times[own].sum() >= 20 else -1
    for b in range(1, 66):  # a bucket with hardly an event takes its neighbour's weight
        if weights[b] < 0:
            weights[b] = weights[b - 1] if b > 1 else 0.2
    return m, weights


def score(docs: DataFrame, train: Column, deleted: int = 20) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score of every document."""
    table = chunks(docs, train, deleted)
    spark = docs.sparkSession
    many = table.where("part = 4 and piece = 0").count()
    shards = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), many // 4)
    answered = answers(table, shards)
    stats = np.zeros(4)
    sums = answered.where("chunk < 0").select("a")

    def add(batches):
        got = [np.frombuffer(x, np.float64) for batch in batches for x in batch.column(0).to_pylist()]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in np.sum(got, axis=0)], ["v", "n", "w", "m"])

    row = sums.mapInArrow(common.lean(add), "v double, n double, w double, m double").agg(F.sum("v"), F.sum("n"), F.sum("w"), F.sum("m")).first()
    stats = np.array([x or 0.0 for x in row])
    v, n, v_main, n_main = stats.tolist()
    m, weights = learn(table, answered, n_main, v_main)
    names = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(chunk: Chunk):
        doc = np.repeat(np.arange(len(chunk.size)), chunk.size)
        known, base, total = (np.zeros(len(chunk.size)) for _ in range(3))
        for k, context, word, both in chunk.counts(False):
            own = doc[k : k + SLICE]
            w = weights[bucket(context)]
            low = m * word / max(n, 1) + (1 - m) / (v + 1)
            p = w * both / np.maximum(context, 1) + (1 - w) * low
            for to, x in ((known, word > 0), (base, np.log10((word + 1) / (n + v + 1))), (total, np.log10(p))):
                to += np.bincount(own, weights=x, minlength=len(to))
        tokens = np.full(len(chunk.size), int(n), np.int64)
        yield pa.RecordBatch.from_arrays([chunk.doc_ids, pa.array(chunk.train), pa.array(chunk.size), pa.array(known.astype(np.int64)), pa.array(tokens), pa.array(base), pa.array(total)], names)

    found = by_chunk(table, answered, False, run, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return common.write_table(found, "scores", batch=BATCH)  # a narrow table; written, so that a chunk's megabytes go to Python in small batches
