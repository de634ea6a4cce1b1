"""Shared pieces: scratch tables in the cluster's shared folder, and word boundaries and hashes of Arrow text batches.

Words are maximal runs of bytes other than space and 0x09-0x0D; they are found and hashed with numpy on
the UTF-8 bytes of an Arrow batch, a few MB at a time, so that memory does not follow the batch's size.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
#: A fixed random 64-bit value for each byte.
_BYTE = np.random.Generator(np.random.PCG64(20240817)).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
SEGMENT = 2 << 20
BATCH_BYTES = 4 << 20
#: Bits of the filter that tells most rows apart from those of a table of keys.
FILTER = 1 << 23
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_powers: list[np.ndarray] = []
WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set (tests), a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sylva_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="sylva-")
            spark._sylva_scratch = base
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone; its folder goes with it
        return


def bound_batches(spark: SparkSession) -> SparkSession:
    """Holds the session's Arrow batches to BATCH_BYTES, unless it asks for less, so that a worker's memory does not follow the texts' sizes. It stays so, as results are computed later."""
    was = spark.conf.get(_BATCH, None)
    if was is None or not was.isdigit() or int(was) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


#: For tables of wide cells that are compressed themselves: else Parquet looks at a page's size after 100 rows only, so that a page, its codec's
#: buffers and a row group hold a task's whole output, when written and when read. A row group is read as one array, so it is held under half a
#: megabyte, beyond which G1 takes more heap rather than collect.
WIDE = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.page.size": str(128 << 10), "parquet.block.size": str(384 << 10)}


def write_table(df: DataFrame, name: str, options: dict[str, str] | None = None, batch: int = BATCH_BYTES) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back. Deleted when Python exits. batch: bytes of an Arrow batch at most, if fewer."""
    spark = bound_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/sylva-{uuid.uuid4().hex[:12]}/{name}"
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(was), batch)))
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_BATCH, was)
    atexit.register(_delete, spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free in this process back to the system; an idle worker would keep it from others on its machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, with free memory given back after every BATCH_BYTES / 2 of its input and at its end."""

    def each(batches):
        def fed():
            seen = 0
            for batch in batches:
                seen += batch.nbytes
                yield batch
                del batch
                if seen > BATCH_BYTES // 2:
                    release()
                    seen = 0

        try:
            yield from run(fed())
        finally:
            release()

    return each


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of the first column, by which rows come sorted, and where the runs begin and end. Each row is copied once, however long its run."""

    def cut(parts):
        table = pa.concat_tables(parts)
        key = table.column(0).to_numpy()
        return table, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table, key = pa.Table.from_batches([batch]), batch.column(0).to_numpy()
        if held and key[0] != last:
            yield cut(held)
            held = []
        last = key[-1]
        other = np.flatnonzero(key != last)
        if len(other):
            yield cut([*held, table.slice(0, int(other[-1]) + 1)])
            held = [table.slice(int(other[-1]) + 1)]
        else:
            held.append(table)
    if held:
        yield cut(held)


def parted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that are certainly not among keys, and the others with _sylva_x, the hash of their text.

    keys: a written table with i, an id or null, and h, the hash of a text; both tell rows apart, as ids may repeat or be null. A filter
    of FILTER bits decides (FILTER / 64 rows at most, so that it can be broadcast); so whole texts are dealt for little more than the rows that a
    join with keys concerns. A full filter passes nothing over: that costs time, never rows.
    """
    at = lambda *c: F.pmod(F.xxhash64(*c), F.lit(FILTER))
    words = keys.select(at("i", "h").alias("b")).groupBy(F.shiftright("b", 6).alias("_sylva_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("_sylva_m"))
    rows = docs.withColumn("_sylva_x", F.xxhash64("text"))
    rows = rows.withColumn("_sylva_b", at("doc_id", "_sylva_x")).withColumn("_sylva_w", F.shiftright("_sylva_b", 6)).join(F.broadcast(words), "_sylva_w", "left")
    hit = F.coalesce(F.expr("shiftright(_sylva_m, cast(_sylva_b & 63 as int)) & 1 = 1"), F.lit(False))
    return rows.where(~hit).select(*docs.columns), rows.where(hit).select(*docs.columns, "_sylva_x")


def same_row(rows: DataFrame, keys: DataFrame):
    """Whether a row of parted() and one of keys have the same id, null included, and text."""
    return rows["doc_id"].eqNullSafe(keys["_sylva_i"]) & (rows["_sylva_x"] == keys["_sylva_h"])


def small_table(spark: SparkSession, schema: str, columns: list[list]) -> DataFrame:
    """A table of a few values of the driver, made as an Arrow table: rows given as Python objects would start further Python workers on the executors, which stay."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind), strict=True)], schema=to_arrow_schema(kind)), kind)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + (n >> 2), 1 << 18) + 1
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64))), dtype=np.uint64) for x in (_MULT, _INV)]
    return _powers[0], _powers[1]


def slice_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end] for each pair."""
    pw, ipw = _power(len(b))
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * pw[: len(b)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * ipw[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[off[0] : off[-1]], off - off[0]


def segments(b: np.ndarray, off: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, start, end) of pieces of about size bytes. A longer row is cut before white space that follows a word."""
    n, i = len(off) - 1, 0
    while i < n:
        if off[i + 1] - off[i] <= size:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield i, j, int(off[i]), int(off[j])
            i = j
            continue
        at, end = int(off[i]), int(off[i + 1])
        while at < end:
            to = min(at + size, end)
            while to < end:
                upto = min(to + 65536, end)
                gap = np.flatnonzero(WS[b[to:upto]] & ~WS[b[to - 1 : upto - 1]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = upto
            yield i, i + 1, at, to
            at = to
        i += 1


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


def word_bounds(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of b; a word ends at a row's end."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~WS[b]
    brk = np.zeros(len(b) + 1, bool)
    brk[off] = True
    before = np.empty(len(b), bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(len(b), bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    return np.flatnonzero(word & (before | brk[:-1])), np.flatnonzero(word & (after | brk[1:])) + 1


def words(b: np.ndarray, off: np.ndarray, lower: bool = False, size: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the rows: (first row, last row + 1, bytes, starts, ends, hashes, row of each word)."""
    for i, j, s, e in segments(b, off, size):
        part = lower_ascii(b[s:e]) if lower else b[s:e]
        own = np.clip(off[i : j + 1] - s, 0, e - s)
        starts, ends = word_bounds(part, own)
        yield i, j, part, starts, ends, slice_hash(part, starts, ends), np.searchsorted(own, starts, "right") - 1 + i


def crc32_text(doc_id) -> int:
    """Unsigned crc32 of an id as text, as the SQL function crc32(cast(doc_id as string)) gives it."""
    import zlib

    return zlib.crc32(str(doc_id).encode())
