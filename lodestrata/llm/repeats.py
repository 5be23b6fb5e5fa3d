"""Where stretches of text repeat: windows of bytes or words, met under anchors.

A *window* is ``span`` consecutive items (bytes or words) of one document.  Its
*anchor* is its least gram of ``gram`` items by hash, so equal windows have equal
anchors wherever they stand.  Consecutive windows with one anchor form a
*superwindow*, the unit that is shuffled: one row for a dozen items instead of one
per item.  Superwindows that follow each other with equal content (a text that
repeats itself) are one row with a count.  Rows travel as packed byte planes, one
blob per task and bucket of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import RID, column, delta, low_bytes, merge_spans, pack, payload_batch, payload_table, split_by, text_chunks, unpack

#: Rows that a task gathers before it sends them.
FLUSH_ROWS = 500_000
BLOB = "bucket long, payload binary"
KINDED = "kind long, bucket long, payload binary"
#: Kinds of rows: superwindows by bucket of their anchor, and stretches to remove by bucket of their document.
FOUND, REMOVE = 9, 0


@dataclass(frozen=True)
class Spec:
    """kind: ``bytes`` or ``words``; span: items of a window; gram: items of an anchor."""

    kind: str
    span: int
    gram: int

    @property
    def grams(self) -> int:
        return self.span - self.gram + 1


@dataclass
class Found:
    """Superwindows: row number of the document, first item, windows, repetitions, anchor, content, check."""

    rid: np.ndarray
    start: np.ndarray
    n: np.ndarray
    times: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    check: np.ndarray

    LAYOUT = ("i8", "u4", "u1", "u4", "u5", "u6", "u4")

    def pack(self) -> bytes:
        return pack(delta(self.rid), self.start.astype(np.uint32), self.n.astype(np.uint8), self.times.astype(np.uint32), low_bytes(self.anchor, 5), low_bytes(self.content, 6), self.check.astype(np.uint32))

    @classmethod
    def unpack(cls, data: bytes) -> Found:
        rid, *rest = unpack(data, *cls.LAYOUT)
        return cls(np.cumsum(rid), *rest)

    def take(self, at: np.ndarray) -> Found:
        return Found(*(c[at] for c in self.columns()))

    def columns(self) -> list[np.ndarray]:
        return [self.rid, self.start, self.n, self.times, self.anchor, self.content, self.check]

    @classmethod
    def join(cls, parts: list[Found]) -> Found:
        return cls(*(np.concatenate(c) for c in zip(*(p.columns() for p in parts), strict=True))) if parts else cls(*(np.zeros(0, d) for d in ("i8", "u4", "u1", "u4", "u8", "u8", "u4")))

    def __len__(self) -> int:
        return len(self.rid)


def scan(spec: Spec, rid: np.ndarray, buf: np.ndarray, off: np.ndarray) -> Found:
    """All superwindows of a chunk, in the order of the text."""
    if spec.kind == "bytes":
        items, value = off, ts.BYTE_A[buf]
        pre = ts.prefix(value)
        n = len(buf) - spec.gram + 1
        at = np.arange(max(n, 0))
        h = ts.spans(pre, at, at + spec.gram)
        other = ts.BYTE_B[buf]
    else:
        ws, we, items = ts.words(buf, off, ts.SPACED)
        value = ts.word_hashes(buf, ws, we)
        h, pre = ts.grams(value, spec.gram), ts.prefix(value)
        other = ts.word_hashes(buf, ws, we, other=True)
    doc, start, n, a = ts.superwindows(h, spec.grams, spec.span, items)
    if not len(doc):
        return Found.join([])
    end = start + n - 1 + spec.span
    content = ts.spans(pre, start, end)
    check = ts.spans(ts.prefix(other, ts.BASE_B), start, end, ts.BASE_B)
    anchor = h[a]
    again = np.r_[False, (doc[1:] == doc[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1]) & (start[1:] == start[:-1] + n[:-1])]
    first = np.flatnonzero(~again)
    times = np.diff(np.append(first, len(doc)))
    doc, start = doc[first], start[first]
    return Found(rid[doc], (start - items[doc]).astype(np.uint32), n[first].astype(np.uint8), times.astype(np.uint32), anchor[first], content[first] & ts.U(0xFFFFFFFFFFFF), (check[first] >> ts.U(32)).astype(np.uint32))


def without_copies(f: Found, every: bool) -> tuple[Found, Found]:
    """(f without superwindows that a smaller document of f has too, those); every: also without those that stand again in the same document, in the order of f.

    A copy is removed whatever else there is, and takes part in nothing else, so it
    doesn't need to travel: of a passage that very many documents share, a task sends
    one row.
    """
    order = np.argsort(f.content ^ (f.anchor << ts.U(24)), kind="stable")
    g = f.take(order)
    differs = np.r_[True, (g.content[1:] != g.content[:-1]) | (g.anchor[1:] != g.anchor[:-1]) | (g.n[1:] != g.n[:-1]) | (g.check[1:] != g.check[:-1])] if len(g) else np.zeros(0, bool)
    first = np.flatnonzero(differs)
    if len(first) == len(g):
        return f, f.take(np.zeros(0, np.int64))
    group = np.cumsum(differs) - 1
    least = np.minimum.reduceat(g.rid, first)[group]
    copy = g.rid > least
    if every:
        # of the smallest document's own places the first stays; a document's superwindows are in the order of its text
        own = np.flatnonzero(~copy)
        copy[own[np.r_[False, group[own[1:]] == group[own[:-1]]]]] = True
    gone = np.zeros(len(f), bool)
    gone[order] = copy
    return f.take(~gone), f.take(gone)


def superwindow_blobs(spec: Spec, n_buckets: int):
    """For mapInArrow over (RID, text): blobs of superwindows (FOUND) by bucket of the anchor's high bits, and the stretches of copies (REMOVE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[Found] = []

        def flush() -> pa.RecordBatch:
            f, gone = without_copies(Found.join(have), spec.kind == "words")
            have.clear()
            bucket = ((f.anchor >> ts.U(40)) % ts.U(n_buckets)).astype(np.int64)
            rows = [(FOUND, b, Found(*cols).pack()) for b, cols in split_by(bucket, *f.columns())]
            start = gone.start.astype(np.int64)
            rows += span_rows(REMOVE, gone.rid, start, start + gone.times.astype(np.int64) * gone.n - 1 + spec.span, n_buckets)
            return payload_batch(rows, ("kind", "bucket", "payload"))

        for batch, buf, off in text_chunks(batches):
            have.append(scan(spec, column(batch, RID), buf, off))
            if sum(map(len, have)) > FLUSH_ROWS:
                yield flush()
        yield flush()

    return run


def gathered(table: pa.Table) -> tuple[Found, list[tuple]]:
    """The superwindows of a bucket, and its rows of stretches to remove, which only pass."""
    parts, passing = [], []
    for kind, bucket, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True):
        if kind == FOUND:
            parts.append(Found.unpack(payload))
        else:
            passing.append((kind, bucket, payload))
    return Found.join(parts), passing


def span_rows(kind: int, rid: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows (kind, bucket of the document, blob) of stretches of documents, united where they touch."""
    rid, start, end = merge_spans(rid, start.astype(np.int64), end.astype(np.int64))
    bucket = (ts.mix(rid.astype(np.uint64)) % ts.U(n_buckets)).astype(np.int64)
    return [(kind, b, pack(delta(r), s.astype(np.uint32), (e - s).astype(np.uint32))) for b, (r, s, e) in split_by(bucket, rid, start, end)]


def per_document(blobs: DataFrame) -> DataFrame:
    """(RID, payload of start and end) from blobs of span_rows(): one row per document with anything to remove."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "i8", "u4", "u4") for x in table.column("payload").to_pylist()]
        rid = np.concatenate([np.cumsum(p[0]) for p in parts])
        start = np.concatenate([p[1] for p in parts]).astype(np.int64)
        end = start + np.concatenate([p[2] for p in parts])
        rid, start, end = merge_spans(rid, start, end)
        return payload_table([(r, pack(s, e)) for r, (s, e) in split_by(rid, start.astype(np.uint32), end.astype(np.uint32))], (RID, "payload"))

    return blobs.select("bucket", "payload").groupBy("bucket").applyInArrow(run, f"{RID} long, payload binary")


def spans_of(payload: bytes | None) -> list[np.ndarray]:
    return unpack(payload, "u4", "u4") if payload else [np.zeros(0, np.uint32)] * 2


def rep_rows(kind: int, rid: np.ndarray, *columns: np.ndarray, n_buckets: int) -> list[tuple]:
    """Rows (kind, bucket of the document, blob) of superwindows whose text is needed."""
    bucket = (ts.mix(rid.astype(np.uint64)) % ts.U(n_buckets)).astype(np.int64)
    out = []
    for b, (r, *cols) in split_by(bucket, rid, *columns):
        o = np.argsort(r, kind="stable")
        out.append((kind, b, pack(delta(r[o]), *(c[o] for c in cols))))
    return out


def reps_per_document(blobs: DataFrame, *dtypes: str) -> DataFrame:
    """(RID, payload) from blobs of rep_rows(): one row per document, repeated entries once."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "i8", *dtypes) for x in table.column("payload").to_pylist()]
        cols = [np.concatenate(c) for c in zip(*([np.cumsum(p[0]), *p[1:]] for p in parts), strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
        return payload_table([(r, pack(*rest)) for r, rest in split_by(cols[0][new], *(c[new] for c in cols[1:]))], (RID, "payload"))

    return blobs.select("bucket", "payload").groupBy("bucket").applyInArrow(run, f"{RID} long, payload binary")


def only(blobs: DataFrame, kind: int) -> DataFrame:
    return blobs.filter(F.col("kind") == kind)
