"""What the operators share: scratch space, row identity, chunks, packed columns."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; bounds a worker's memory, about a hundred times that (a longer text is a chunk by itself).
CHUNK_BYTES = 1 << 19
#: Bytes of packed side data up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: Name of the internal row number, the mark of a column that is it, and the name of a user's column of that name meanwhile.
RID = "__ls_rid"
_MARK = {"row number": True}
_THEIRS = "__ls_rid_given"
#: While an intermediate table is written, its shuffle files go when the write ends.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most 4 MB for the session, unless it has smaller ones: documents can be long, and batches count twice."""
    now = spark.conf.get(_BATCH)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
        spark.conf.set(_BATCH, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/lodestrata"


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"




class _Tables(threading.local):
    """For each open temporary() of a thread: the tables written in it."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_TABLES = _Tables()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that spill() writes meanwhile, but for those that it is told to keep (they are the next outer one's)."""
    _TABLES.open.append([])
    try:
        yield
    finally:
        for path in _TABLES.open.pop():
            remove(spark, path)


def spill(df: DataFrame, tag: str, *partition_by: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: later jobs don't repeat it, and it survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    if len(_TABLES.open) > keep:
        _TABLES.open[-1 - keep].append(path)
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column RID: one number per row that orders rows by id.

    The number is the id itself where ids are unique and present.  Otherwise rows
    that repeat an id count as documents of their own, ordered by a hash of their
    text, and rows without an id come last; every row is kept.  A user's column of
    the name RID is put aside until original() is called.
    """
    bound_batches(docs.sparkSession)
    if _is_numbered(docs):
        return docs
    columns = [F.col(c).alias(_THEIRS) if c == RID else F.col(c) for c in docs.columns]
    key = F.col(id_col).cast("long")
    repeated = docs.groupBy(key.alias("k")).count().filter("count > 1 or k is null").limit(1)
    if not repeated.take(1):
        return docs.select(*columns, key.alias(RID, metadata=_MARK))
    ordered = docs.orderBy(key.asc_nulls_last(), F.xxhash64(text_col))
    return spill(ordered.select(*columns, F.monotonically_increasing_id().alias(RID, metadata=_MARK)), "rows")


def _is_numbered(docs: DataFrame) -> bool:
    return RID in docs.columns and docs.schema[RID].metadata == _MARK


def original(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from numbered(docs) or what was made of it."""
    theirs = RID in docs.columns and not _is_numbered(docs)
    return rows.select(*(F.col(_THEIRS).alias(RID) if theirs and c == RID else F.col(c) for c in docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, doc_id, text) of numbered() rows."""
    return numbered(docs, id_col, text_col).select(RID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def buckets_for(total_bytes: int, each: int = 8 << 20, least: int = 12) -> int:
    """Buckets so that one task's share of the input stays bounded."""
    return max(least, -(-total_bytes // each))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the borders of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def cuts(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes (one longer document stands alone)."""
    at, n = 0, len(off) - 1
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches whose column ``text`` fits a chunk, with its bytes and borders."""
    for batch in batches:
        buf, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for a, b in cuts(off, limit):
            o = off[a : b + 1]
            yield batch.slice(a, b - a), buf[o[0] : o[-1]], o - o[0]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as byte planes (equal high bytes then compress to nothing in shuffles and files)."""
    n = len(columns[0])
    if not n:
        return bytes(4)
    return b"".join([np.uint32(n).tobytes(), *(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)])


def unpack(data: bytes, *dtypes: str) -> list[np.ndarray]:
    """The columns of pack(); a number as dtype (``u5``, ``u6``) is an unsigned integer of so many bytes."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out, at = [], 4
    for dtype in dtypes:
        wide = np.dtype("u8" if dtype in ("u5", "u6") else dtype)
        size = int(dtype[1:])
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        at += n * size
        value = np.zeros((n, wide.itemsize), np.uint8)
        value[:, :size] = planes.T
        out.append(value.reshape(-1).view(wide))
    return out


def low_bytes(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit values, for pack()."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8)[:, :size]


def delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype(np.int64), prepend=np.int64(0))


def split_by(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, its part of the columns) in the columns' order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    borders = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
    cols = [c[order] for c in columns]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield int(k[a]), [c[a:b] for c in cols]


def payload_batch(rows: list[tuple], names: tuple[str, ...] = ("bucket", "payload")) -> pa.RecordBatch:
    """A batch of (integers ..., payload) rows."""
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    arrays = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def payload_table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.Table.from_batches([payload_batch(rows, names)])


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open stretches within documents: sorted, disjoint, not touching."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    # a running maximum that restarts with each document: lift each document above the last
    lift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    begins = np.r_[True, start[1:] + lift[1:] > reach[:-1]] | new_doc
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - lift[last]


def attach(docs: DataFrame, side: DataFrame, key: str = RID, how: str = "left", each: Column | None = None, broadcast: bool = True) -> DataFrame:
    """Joins per-document data to the texts; side is (key, payload, ...), written before, one row per key.

    Side data of at most BROADCAST_BYTES are broadcast; beyond that both sides are
    shuffled by key.  The size is measured, not estimated; each: bytes of a row.
    broadcast=False: for side data that are a fixed share of the text, both sides are
    shuffled at any size.
    """
    if not broadcast:
        return docs.join(side.hint("shuffle_hash"), key, how)
    each = F.octet_length("payload") + F.lit(64) if each is None else each
    size = side.agg(F.sum(each)).first()[0] or 0
    return docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("shuffle_hash"), key, how)
