"""Exact substring removal with a collection Burrows-Wheeler transform built column by column.

Segments of the documents enter the transform one symbol per segment and round,
from their ends: round j inserts the suffix of length j of every segment.  The
transform, the common prefixes of neighbouring suffixes and the column that says which
suffix stands where are external files (in memory while they are small).  A round reads the first two once, in order
and block by block, to find where the new suffixes belong and what they have in common
with their neighbours, and then writes all three once, in order.  In memory are a
block, a few numbers for each of the 256 symbols, and two numbers per segment.

Whole documents as strings would need as many rounds as the longest document has
bytes, each over the whole file.  The strings are therefore the *superwindows*
(see ``repeats``) of anchors that at least two documents share: at most
``2 * span - gram`` bytes, so the rounds are bounded by the window and not by the
text; a byte string of ``span`` bytes lies whole in exactly one superwindow, and
equal ones meet in the same transform.  Text that no other document shares never
enters one, and of a superwindow only as much around its anchor as some other one has
too (by hashes, which may keep too much but never too little).

Results are exact up to collisions of 93-bit fingerprints in the first step
(copies of whole superwindows); inside a transform bytes are compared, not hashes.

Nulls count as empty text; documents shorter than ``span`` lose nothing; rows that
repeat an id are documents of their own in the order of a hash of their text, rows
without an id come last; an empty table gives an empty result.  Columns besides id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import RID, attach, buckets_for, column, delta, identify, pack, payload_batch, payload_table, remove, scratch, spill, split_by, temporary, text_bytes, text_chunks, unpack
from .repeats import BLOB, KINDED, Spec, gathered, only, per_document, rep_rows, reps_per_document, span_rows, spans_of, superwindow_blobs

#: Entries of a column that are in memory at once.
_BLOCK = 1 << 19
#: Strings of a collection, at least as many as share an anchor.
_COLLECTION = 4096
#: Bytes of a collection whose columns are held in memory; those of larger ones are files.
_HELD = 4 << 20


class Storage:
    """Sequential files: in a folder that all executors share, or held in memory where Python can't reach that."""

    def __init__(self, folder: str | None) -> None:
        self.folder, self.held = folder, {}
        if folder:
            os.makedirs(folder, exist_ok=True)

    def reader(self, name: str):
        return open(os.path.join(self.folder, name), "rb") if self.folder else io.BytesIO(self.held[name])

    @contextmanager
    def writer(self, name: str):
        with open(os.path.join(self.folder, name), "wb") if self.folder else io.BytesIO() as f:
            yield f
            if not self.folder:
                self.held[name] = f.getvalue()

    def drop(self, name: str) -> None:
        if self.folder:
            os.unlink(os.path.join(self.folder, name))
        else:
            del self.held[name]

    def close(self) -> None:
        self.held = {}
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class ExternalColumn:
    """A column in a file; insert() reads it and writes the next one, both from front to back."""

    def __init__(self, storage: Storage, name: str, dtype: str, first: np.ndarray) -> None:
        self.storage, self.base, self.round, self.dtype, self.length = storage, name, 0, np.dtype(dtype), len(first)
        with storage.writer(self._name()) as f:
            f.write(first.astype(self.dtype).tobytes())

    def _name(self, ahead: int = 0) -> str:
        return f"{self.base}.{self.round + ahead}"

    def _take(self, f, n: int) -> np.ndarray:
        return np.frombuffer(f.read(n * self.dtype.itemsize), self.dtype)

    def insert(self, at: np.ndarray, values: np.ndarray, put_at: np.ndarray | None = None, put: np.ndarray | None = None) -> None:
        """values come to stand at the positions ``at`` (ascending) of the new column, and ``put`` replaces what is at put_at (ascending) there."""
        total, done, used, set_ = self.length + len(at), 0, 0, 0
        with self.storage.reader(self._name()) as old, self.storage.writer(self._name(1)) as new:
            while done < total:
                end = min(total, done + _BLOCK)
                upto = int(np.searchsorted(at, end))
                block = np.empty(end - done, self.dtype)
                fresh = np.zeros(end - done, bool)
                fresh[at[used:upto] - done] = True
                block[fresh] = values[used:upto]
                block[~fresh] = self._take(old, end - done - (upto - used))
                if put_at is not None:
                    also = int(np.searchsorted(put_at, end))
                    block[put_at[set_:also] - done] = put[set_:also]
                    set_ = also
                new.write(block.tobytes())
                done, used = end, upto
        self.storage.drop(self._name())
        self.round += 1
        self.length = total

    def blocks(self) -> Iterator[np.ndarray]:
        with self.storage.reader(self._name()) as f:
            for a in range(0, self.length, _BLOCK):
                yield self._take(f, min(_BLOCK, self.length - a))

    def read(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.dtype), *self.blocks()])


def _range_min(values: np.ndarray):
    """A function of (first, last), both inclusive, for minima of stretches of small integers."""
    levels = [values]
    while len(levels[-1]) > (step := 1 << (len(levels) - 1)):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))

    def query(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), values.dtype)
        for level in np.unique(k):
            m = k == level
            out[m] = np.minimum(levels[level][first[m]], levels[level][last[m] - (1 << int(level)) + 1])
        return out

    return query


_NONE = 255  # above all common prefixes


def _neighbours(bwt: ExternalColumn, lcp: ExternalColumn, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """For entries (ascending places): their symbol, how many before have it, and the common prefixes of their stretches to the last and to the next entry with it (_NONE: there is none).

    One pass over both columns.  Between blocks are kept, for each symbol: how often
    it came, the least common prefix since, and the last entry that waits for it.
    """
    q = len(place)
    symbol, rank, before, after = np.zeros(q, np.int64), np.zeros(q, np.int64), np.full(q, _NONE), np.full(q, _NONE)
    seen, since = np.zeros(256, np.int64), np.full(256, _NONE)
    waiting, waited = np.full(256, -1), np.full(256, _NONE)
    begin = done = 0
    for b, c in zip(bwt.blocks(), lcp.blocks(), strict=True):
        size = len(b)
        upto = int(np.searchsorted(place, begin + size))
        mine, x = slice(done, upto), place[done:upto] - begin
        order = np.argsort(b, kind="stable")
        count = np.bincount(b, minlength=256)
        border = np.cumsum(count) - count
        there = np.flatnonzero(count)
        first, last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        first[there], last[there] = order[border[there]], order[border[there] + count[there] - 1]
        upto_here, from_here = np.minimum.accumulate(c), np.append(np.minimum.accumulate(c[::-1])[::-1], _NONE)
        # who waits for a symbol of this block
        hit = there[waiting[there] >= 0]
        after[waiting[hit]] = np.minimum(waited[hit], upto_here[first[hit]])
        waiting[hit] = -1
        waited = np.minimum(waited, from_here[0])
        if len(x):
            at = np.empty(size, np.int64)
            at[order] = np.arange(size)
            s, r = b[x].astype(np.int64), at[x]
            own = r - border[s]
            symbol[mine], rank[mine] = s, seen[s] + own
            least = _range_min(c)
            inside = own > 0
            found = np.where(seen[s] > 0, np.minimum(since[s], upto_here[x]), _NONE)
            found[inside] = least(order[r[inside] - 1] + 1, x[inside])
            before[mine] = np.where((seen[s] > 0) | inside, found, _NONE)
            inside = own + 1 < count[s]
            found = np.full(len(x), _NONE)
            found[inside] = least(x[inside] + 1, order[r[inside] + 1])
            after[mine] = found
            tail = np.flatnonzero(~inside)
            waiting[s[tail]], waited[s[tail]] = done + tail, from_here[x[tail] + 1]
        since = np.minimum(since, from_here[0])
        since[there] = from_here[last[there] + 1]
        seen += count
        begin, done = begin + size, upto
    return symbol, rank, before, after, seen


def collection_bwt(segments: np.ndarray, off: np.ndarray, storage: Storage) -> tuple[ExternalColumn, ExternalColumn, ExternalColumn]:
    """The transform of a collection of byte strings, built by insertion of columns.

    segments, off: bytes and borders.  Returns external columns in suffix order:
    preceding symbol (byte + 1; 0 where a string starts), common prefix with the suffix
    before, and string number (high bits) with suffix length (low byte).  Ends of
    strings sort before all bytes and, among themselves, by string number.
    """
    length = np.diff(off)
    n = len(length)
    limit = int(length.max(initial=0))
    assert limit < 255, "common prefixes are kept in one byte"
    # bytes of UTF-8 are at most 0xF4, so that byte + 1 is a byte too
    sym = lambda ids, j: np.where(length[ids] >= j, segments[np.maximum(off[ids + 1] - j, 0)].astype(np.uint16) + 1, 0).astype(np.uint8)
    ids = np.arange(n)
    bwt, lcp = ExternalColumn(storage, "bwt", "u1", sym(ids, 1)), ExternalColumn(storage, "lcp", "u1", np.zeros(n, np.uint8))
    suffix = ExternalColumn(storage, "suffix", "u8" if n >= 1 << 24 else "u4", ids << 8)
    active, place = ids, ids  # strings with symbols left, by the place of their longest suffix
    for j in range(1, limit + 1):
        keep = length[active] >= j
        active, place = active[keep], place[keep]
        symbol, rank, before, after, seen = _neighbours(bwt, lcp, place)
        # suffixes one symbol longer stand by that symbol, then in the order of what follows it
        new = n + rank + (np.cumsum(seen) - seen)[symbol] - seen[0]
        order = np.argsort(new, kind="stable")
        new, active = new[order], active[order]
        longer = lambda x: np.where(x == _NONE, 0, np.minimum(x, 253) + 1)[order].astype(np.uint8)
        total = bwt.length + len(active)
        inner = new + 1 < total
        bwt.insert(new, sym(active, j + 1))
        lcp.insert(new, longer(before), new[inner] + 1, longer(after)[inner])
        suffix.insert(new, active << 8 | j)
        place = new
    return bwt, lcp, suffix


def shared_windows(rid: np.ndarray, segments: np.ndarray, off: np.ndarray, span: int, storage: Storage) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window of ``span`` bytes that also stands in a segment of a smaller document."""
    _, lcp, suffix = collection_bwt(segments, off, storage)
    segs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def judge(whose: np.ndarray, tail: np.ndarray, begins: np.ndarray) -> None:
        """Of whole groups of suffixes whose first span bytes agree; shorter suffixes stand alone in theirs."""
        if not len(whose):
            return
        doc = rid[whose]
        least = np.minimum.reduceat(doc, begins)
        hit = (tail >= span) & (doc > np.repeat(least, np.diff(np.append(begins, len(doc)))))
        segs.append(whose[hit])
        places.append((off[whose + 1] - off[whose] - tail)[hit])

    held = np.zeros(0, np.int64)  # the group that the last block ended in
    for c, which in zip(lcp.blocks(), suffix.blocks(), strict=True):
        begins = np.flatnonzero(c < span) + len(held)
        held = np.concatenate([held, which.astype(np.int64)])
        if len(begins):
            cut = int(begins[-1])
            judge(held[:cut] >> 8, held[:cut] & 255, np.union1d([0], begins[:-1]) if cut else begins[:0])
            held = held[cut:]
    judge(held >> 8, held & 255, np.zeros(1, np.int64))
    return np.concatenate(segs), np.concatenate(places)


def _match(spec: Spec, n_buckets: int):
    """First step in a bucket of anchors: kind 0, stretches equal to a superwindow of a smaller document; kind 1, what needs a transform."""

    def run(table: pa.Table) -> pa.Table:
        f, passing = gathered(table)
        if not len(f):
            return payload_table(passing, ("kind", "bucket", "payload"))
        bucket = table.column("bucket")[0].as_py()
        f = f.take(np.lexsort((f.rid, f.check, f.n, f.content, f.anchor)))
        new_a = np.r_[True, f.anchor[1:] != f.anchor[:-1]]
        new_s = new_a | np.r_[True, (f.content[1:] != f.content[:-1]) | (f.n[1:] != f.n[:-1]) | (f.check[1:] != f.check[:-1])]
        of_a, of_s = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
        at_a = np.flatnonzero(new_a)
        shared = np.minimum.reduceat(f.rid, at_a) != np.maximum.reduceat(f.rid, at_a)
        contents = np.bincount(of_a[new_s])
        copy = f.rid > f.rid[new_s][of_s]
        open_ = shared[of_a] & (contents[of_a] > 1) & ~copy
        c, o = f.take(copy), f.take(open_)
        start = c.start.astype(np.int64)
        rows = passing + span_rows(0, c.rid, start, start + c.times.astype(np.int64) * c.n - 1 + spec.span, n_buckets)
        rows += rep_rows(1, o.rid, o.start, o.n, o.times, np.full(len(o), bucket, np.uint32), n_buckets=n_buckets)
        return payload_table(rows, ("kind", "bucket", "payload"))

    return run


def _segments(spec: Spec):
    """For mapInArrow over (RID, text, payload): the text of superwindows, by bucket of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple] = []

        def flush() -> pa.RecordBatch:
            meta = [np.concatenate(c) for c in zip(*(h[:-1] for h in have), strict=True)]
            data = np.concatenate([h[-1] for h in have])
            have.clear()
            bucket, rid, start, n, times = meta
            size = n.astype(np.int64) - 1 + spec.span
            at = np.cumsum(size) - size
            rows = []
            for b, (idx,) in split_by(bucket.astype(np.int64), np.arange(len(rid))):
                s = size[idx]
                take = np.repeat(at[idx] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                rows.append((b, pack(delta(rid[idx]), start[idx], n[idx], times[idx]) + data[take].tobytes()))
            return payload_batch(rows)

        for batch, buf, off in text_chunks(batches):
            payloads = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            parts = [(i, *unpack(x, "u4", "u1", "u4", "u4")) for i, x in enumerate(payloads) if x]
            if not parts:
                continue
            doc = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
            start, n, times, bucket = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
            size = n.astype(np.int64) - 1 + spec.span
            begin = off[doc] + start
            take = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            have.append((bucket, column(batch, RID)[doc], start, n, times, buf[take]))
            if sum(len(h[0]) for h in have) > 400_000:
                yield flush()
        if have:
            yield flush()

    return run


def _reach(pre: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and after its anchor a string has in common with some other one, by hashes.

    pre: prefix sums of the bytes' hash; anchor, begin, end: places in them.  A window
    that two strings share stands at the same distance from their anchors, so it ends
    where these bytes end, or before: what is further out needn't enter a transform.
    """
    out = []
    for side in (-1, 1):
        far, alive, room = np.zeros(len(anchor), np.int64), np.arange(len(anchor)), (anchor - begin if side < 0 else end - anchor - gram)
        reach = 0
        while len(alive):
            far[alive] = reach
            reach += 1
            alive = alive[room[alive] >= reach]
            at = anchor[alive]
            which, times = np.unique(ts.spans(pre, at - reach, at + gram) if side < 0 else ts.spans(pre, at, at + gram + reach), return_inverse=True, return_counts=True)[1:]
            alive = alive[times[which] > 1]
        out.append(far)
    return out[0], out[1]


def _transform(spec: Spec, n_buckets: int, root: str | None):
    """Second step in a bucket of anchors: windows that the transform finds in a smaller document, as stretches to remove; root: the folder for columns."""

    def run(table: pa.Table) -> pa.Table:
        metas, texts = [], []
        for x in table.column("payload").to_pylist():
            rid, start, n, times = unpack(x, "i8", "u4", "u1", "u4")
            metas.append((np.cumsum(rid), start.astype(np.int64), n.astype(np.int64), times.astype(np.int64)))
            texts.append(np.frombuffer(x, np.uint8, offset=4 + len(rid) * 17))
        rid, start, n, times = (np.concatenate(c) for c in zip(*metas, strict=True))
        off = np.r_[0, np.cumsum(n - 1 + spec.span)]
        data = np.concatenate(texts)
        # a text that stands several times in its first document enters once
        same: dict[bytes, int] = {}
        raw, border = data.tobytes(), off.tolist()
        uid = np.fromiter((same.setdefault(raw[a:b], len(same)) for a, b in zip(border[:-1], border[1:], strict=True)), np.int64, len(n))
        first = np.unique(uid, return_index=True)[1]
        # segments of one anchor stay together; small collections stay in the processor's cache
        pre = ts.prefix(ts.BYTE_A[data])
        at = np.arange(len(data) - spec.gram + 1)
        h = ts.spans(pre, at, at + spec.gram)
        anchor = ts.superwindows(h, spec.grams, spec.span, off)[3][first]
        ahead, behind = _reach(pre, anchor, off[:-1][first], off[1:][first], spec.gram)
        some = np.flatnonzero(ahead + spec.gram + behind >= spec.span)
        some = some[np.argsort(h[anchor[some]], kind="stable")]
        first, begins, ends = first[some], (anchor - ahead)[some], (anchor + spec.gram + behind)[some]
        key = h[anchor[some]]
        borders = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        segs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(first):
            b = int(borders[min(np.searchsorted(borders, a + _COLLECTION), len(borders) - 1)])
            part, start_at = first[a:b], begins[a:b]
            size = ends[a:b] - start_at
            own = np.r_[0, np.cumsum(size)]
            take = np.repeat(start_at - own[:-1], size) + np.arange(own[-1])
            storage = Storage(f"{root}/{uuid.uuid4().hex}" if root and own[-1] > _HELD else None)
            try:
                seg, at = shared_windows(rid[part], data[take], own, spec.span, storage)
            finally:
                storage.close()
            segs.append(uid[part[seg]])
            places.append(at + (start_at - off[part])[seg])
            a = b
        seg, at = np.concatenate(segs), np.concatenate(places)
        # and what holds for it holds at all its places in that document
        order = np.argsort(uid, kind="stable")
        lo, hi = np.searchsorted(uid[order], seg), np.searchsorted(uid[order], seg, side="right")
        count = hi - lo
        who = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        begin = start[who] + np.repeat(at, count)
        return payload_table(span_rows(0, rid[who], begin, begin + (times[who] - 1) * n[who] + spec.span, n_buckets), ("kind", "bucket", "payload"))

    return run


def repeated_spans(docs: DataFrame, span: int = 50, gram: int = 25) -> DataFrame:
    """(RID, payload): stretches of bytes that a document with a smaller row number has too; docs from identify()."""
    spec = Spec("bytes", span, gram)
    n = buckets_for(text_bytes(docs))
    spark = docs.sparkSession
    with temporary(spark):
        blobs = docs.select(RID, "text").mapInArrow(superwindow_blobs(spec, n), KINDED)
        first = spill(blobs.groupBy("bucket").applyInArrow(_match(spec, n), KINDED), "suffix-first")
        reps = spill(reps_per_document(only(first, 1), "u4", "u1", "u4", "u4"), "suffix-open")
        segments = attach(docs.select(RID, "text"), reps, how="inner", broadcast=False).mapInArrow(_segments(spec), BLOB)
        columns = scratch(spark, "bwt")
        try:
            second = spill(segments.groupBy("bucket").applyInArrow(_transform(spec, n, reachable(spark, columns)), KINDED), "suffix-second")
        finally:
            remove(spark, columns)
        return spill(per_document(only(first, 0).unionByName(second)), "suffix-spans", keep=True)


def reachable(spark: SparkSession, path: str) -> str | None:
    """The shared folder as Python sees it, if it does: a mounted one.  A path without a scheme is where the default file system is."""
    place = urlsplit(path)
    scheme = place.scheme or urlsplit(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return place.path if scheme == "file" else None


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in text_chunks(batches):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for i, payload in enumerate(batch.column(batch.schema.get_field_index("payload")).to_pylist()):
            start, end = spans_of(payload)
            text = buf[off[i] : off[i + 1]].tobytes()
            at, pieces = 0, []
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                pieces.append(text[at:s])
                at = e
            pieces.append(text[at:])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((end.astype(np.int64) - start).sum()))
            out["n_spans"].append(len(start))
            out["kept"].append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_shared_substrings(docs: DataFrame, span: int = 50, gram: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every byte goes that a string of ``span`` bytes covers which also starts in a document with a smaller id.

    kept: the remaining bytes (a cut may fall inside a character, so binary).
    """
    docs = identify(docs, id_col, text_col)
    spans = repeated_spans(docs, span, gram)
    return attach(docs, spans).select("doc_id", "text", "payload").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


__all__ = ["ExternalColumn", "Storage", "collection_bwt", "digest", "remove_shared_substrings", "repeated_spans", "shared_windows"]
