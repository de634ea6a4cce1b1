"""Token ids in binary blocks: canonical length-limited Huffman codes from global counts.

A table `tokens` holds the ids of range-partitioned, sorted documents; each task adds its own counts. The
summed counts (one row an id at most) give code lengths by package-merge, and canonical codes follow from the
lengths alone. A file is a Parquet folder `segments` of byte strings beside a folder `codebook`. A segment holds
whole documents: a header, ids and lengths of its documents, one bit offset for every BLOCK ids, and the bits.
Blocks start at their checkpoints, so each can be decoded alone; decode() steps through all blocks of a segment
at once with one table of 2 ** LIMIT entries.

Order: doc_id ascending, null ids first, rows of one id by a hash of the text. Null and empty texts
hold the end id only. Repeated rows are kept. An empty table gives empty folders and an empty codebook.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LIMIT, BLOCK, SEGMENT_IDS = 16, 256, 1 << 20
_HEAD = struct.Struct("<4sIQQQ")  # mark, ids a block, documents, ids, ids before


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; zero where the count is zero."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64 if counts.sum() > 1 << 50 else np.int64)
    leaf, level = [np.ones(n, bool)], w
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((w, pairs))
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaf.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for mask in reversed(leaf):
        leaves = int(mask[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: ascending by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = ids[lengths[ids] == length]
        code <<= length - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint32)
        code += len(own)
        last = length
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next limit bits."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    span = 1 << (limit - lengths[ids].astype(np.int64))
    sym, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    sym[: span.sum()] = np.repeat(ids, span)
    size[: span.sum()] = np.repeat(lengths[ids], span)
    return sym, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, most significant first, and the bit offset of each block of BLOCK ids."""
    n = lengths[ids].astype(np.int64)
    pos = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    start = pos[:-1]
    wide = codes[ids].astype(np.uint64) << (np.uint64(64) - n.astype(np.uint64) - (start & 31).astype(np.uint64))
    word, size = start >> 5, int(pos[-1] >> 5) + 2
    out = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=size)  # bits are disjoint: a sum below 2 ** 32 is exact
    out[1:] += np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[: size - 1]
    return out.astype(np.uint32).astype(">u4").tobytes()[: int(pos[-1] + 7) // 8], start[::BLOCK]


def encode_segment(doc_ids: list[int | None], count: np.ndarray, ids: np.ndarray, before: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits, offset = pack_bits(ids, codes, lengths)
    return b"".join(
        (
            _HEAD.pack(b"SYH1", BLOCK, len(count), len(ids), before),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            count.astype("<u8").tobytes(),
            offset.astype("<u8").tobytes(),
            bits,
        )
    )


def read_head(data: bytes) -> tuple[list[int | None], np.ndarray, int, int, np.ndarray, int]:
    """Document ids, their numbers of ids, all ids, ids before, the blocks' bit offsets, and where the bits begin."""
    mark, block, docs, n, before = _HEAD.unpack_from(data)
    if mark != b"SYH1" or block != BLOCK:
        raise ValueError("not a segment")
    at = _HEAD.size
    null = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = [None if x else d for d, x in zip(np.frombuffer(data, "<i8", docs, at + docs).tolist(), null.tolist(), strict=True)]
    count = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    blocks = -(-n // BLOCK)
    at += 17 * docs
    return doc_ids, count, n, before, np.frombuffer(data, "<u8", blocks, at).astype(np.int64), at + 8 * blocks


def decode_blocks(data: bytes, table: tuple[np.ndarray, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first to last (not included) of a segment, decoded alone."""
    _, _, n, _, offset, at = read_head(data)
    last = len(offset) if last is None else last
    if last <= first:
        return np.zeros(0, np.uint32)
    start = offset[first] >> 3
    end = min(len(data), at + int(offset[last] >> 3) + 1) if last < len(offset) else len(data)
    raw = data[at + int(start) : end] + bytes(BLOCK * LIMIT // 8 + 8)
    half = np.frombuffer(raw[: len(raw) // 2 * 2], ">u2").astype(np.uint32)
    window = (half[:-1] << np.uint32(16)) | half[1:]
    pos = offset[first:last] - 8 * start
    sym, size = table
    out = np.empty((BLOCK, last - first), np.uint32)
    top = len(window) - 1
    for k in range(BLOCK):
        peek = (window[np.minimum(pos >> 4, top)] << (pos & 15).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[k] = sym[peek]
        pos = pos + size[peek]
    return out.T.ravel()[: n - first * BLOCK]


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """A written table of documents in order: part, at (ids before, in the part), doc_id, n, ids; each part's last row has its counts instead."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    ranged = ranged.select("doc_id", "text", F.xxhash64("text").alias("h")).sortWithinPartitions("doc_id", "h")
    names = ["part", "at", "doc_id", "n", "ids", "counts"]

    def run(batches):
        enc, part, at = tokens.encoder(path), TaskContext.get().partitionId(), 0
        total = np.zeros(max(enc.vocab, end + 1), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                each = list(enc.documents(piece.column(1), end))
                n, ids = [len(x) for x in each], [x.astype(enc.dtype).tobytes() for x in each]
                if each:
                    total += np.bincount(np.concatenate(each), minlength=len(total))
                ats = at + np.concatenate(([0], np.cumsum(n)))
                at = int(ats[-1])
                cols = [pa.array([part] * len(n), pa.int32()), pa.array(ats[:-1], pa.int64()), piece.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return common.write_table(ranged.mapInArrow(common.lean(run), "part int, at long, doc_id long, n long, ids binary, counts binary"), "tokens")


def encode(docs: DataFrame, path: str, end: int = 1) -> tuple[DataFrame, DataFrame]:
    """Writes the file; returns its segments (data) and its codebook (id, bits), both read back."""
    table = tokenised(docs, path, end)
    last = table.where(F.col("counts").isNotNull())

    def spread(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(raw, np.int64)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["id", "n"])

    rows = last.select("counts").mapInArrow(common.lean(spread), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    size = max(rows.column(0).to_pylist(), default=0) + 1
    counts = np.zeros(size, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    parts = last.select("part", "at").toArrow()  # one row a partition
    sums = dict(zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True))
    base, at = {}, 0
    for p in sorted(sums):
        base[p] = at
        at += sums[p]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((codes, lengths, base))
    wide = tokens.encoder(path).dtype

    def run(batches):
        codes, lengths, base = shared.value
        held: list[tuple] = []  # doc_id, n, ids; of one part, one after the other
        start = ids = 0

        def settle():
            data = encode_segment([x[0] for x in held], np.array([x[1] for x in held], np.int64), np.concatenate([np.frombuffer(x[2], wide) for x in held]), start, codes, lengths)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([data], pa.binary())], ["start", "data"])

        for batch in batches:
            for part, at, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = base[part] + at
                if held and (begin != start + ids or ids + n > SEGMENT_IDS):
                    yield settle()
                if not held:
                    start, ids = begin, 0
                held.append((doc, n, raw))
                ids += n
        if held:
            yield settle()

    segments = common.write_table(table.where(F.col("n").isNotNull()).select("part", "at", "doc_id", "n", "ids").mapInArrow(common.lean(run), "start long, data binary"), "segments")
    used = np.flatnonzero(lengths).tolist()
    book = common.write_table(common.small_table(spark, "id long, bits int", [list(used), [int(lengths[i]) for i in used]]), "codebook")
    return segments, book


def decode(segments: DataFrame, book: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids (array) of every document of a file."""
    rows = book.toArrow()  # one row an id at most
    lengths = np.zeros(max(rows.column(0).to_pylist(), default=0) + 1, np.uint8)
    lengths[rows.column(0).to_numpy()] = rows.column(1).to_numpy()

    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                doc_ids, count, _, before, _, _ = read_head(data)
                ids = decode_blocks(data, table).astype("<u4")
                cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
                each = [ids[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(before + cut[:-1], pa.int64()), pa.array(count, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.tolist() for x in each], pa.list_(pa.int64()))] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return segments.select("data").mapInArrow(common.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
