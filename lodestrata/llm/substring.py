"""Incremental removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs.  A run holds, by bucket and sorted by
fingerprint, the first places of the word windows of one batch that no earlier run
has.  A new batch is sorted the same way and merge-joined with the runs: of a run only
what stands under the batch's fingerprints is taken, found by their order, and the
runs themselves are neither sorted again nor shuffled, as their table is laid out in
files by bucket.  What meets under a fingerprint is verified by number of windows and
an independent checksum of the whole stretch before it counts.  When there are more
than ``fan_in`` runs they are merged into one sorted run.  An index can be saved and
opened by a later session.

Fingerprints stand for superwindows (see ``repeats``): runs of 20-word windows with
one anchor.  A superwindow that equals an earlier one is removed as a whole.  Where
an anchor has several different superwindows, their single windows are compared in
a second step, by 128 bits of two independent hashes.

*Earlier* means an earlier batch; within one, a smaller id; within a document, an
earlier word.  Windows are judged on the input, not on what is left.

Nulls count as text without words; shorter texts than a window lose nothing; rows
that repeat an id are documents of their own in the order of a hash of their text,
rows without an id come last; an empty table gives an empty result.  Columns besides id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import RID, attach, buckets_for, column, delta, identify, pack, payload_batch, payload_table, remove, scratch, spill, split_by, temporary, text_bytes, text_chunks, unpack
from .repeats import BLOB, KINDED, REMOVE, Found, Spec, gathered, only, per_document, rep_rows, reps_per_document, span_rows, spans_of, superwindow_blobs

OPEN, RUN = 1, 2


def _sorted(f: Found, *before: np.ndarray) -> np.ndarray:
    """The order of a run: by fingerprint, then by place (``before`` it: what else decides)."""
    return np.lexsort((f.start, f.rid, *before, f.check, f.n, f.content, f.anchor))


def _run_rows(bucket: int, f: Found, gen: np.ndarray) -> list[tuple]:
    return [(RUN, bucket, _run_payload(f, gen))] if len(f) else []


def _run_payload(f: Found, gen: np.ndarray) -> bytes:
    """A sorted run's part of a bucket, with the generation of each row."""
    return pack(gen.astype(np.uint32)) + f.pack()


def _run_of(payload: bytes) -> tuple[Found, np.ndarray]:
    (gen,) = unpack(payload, "u4")
    return Found.unpack(payload[4 + 4 * len(gen) :]), gen.astype(np.int64)


def _met(run: Found, gen: np.ndarray, anchors: np.ndarray) -> tuple[Found, np.ndarray]:
    """The rows of a sorted run under the (sorted, distinct) anchors."""
    low, high = np.searchsorted(run.anchor, anchors), np.searchsorted(run.anchor, anchors, side="right")
    n = high - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return run.take(at), gen[at]


def _merge(spec: Spec, n_buckets: int, generation: int):
    """One bucket: sorted runs and the new batch, merge-joined; kinds REMOVE, OPEN and RUN (the new run's part)."""

    def run(new: pa.Table, runs: pa.Table) -> pa.Table:
        f, passing = gathered(new)
        if not len(f):
            return payload_table(passing, ("kind", "bucket", "payload"))
        bucket = new.column("bucket")[0].as_py()
        anchors = np.unique(f.anchor)
        parts, gens = [f], [np.full(len(f), generation)]
        for x in runs.column("payload"):
            old, gen = _met(*_run_of(x.as_py()), anchors)
            parts.append(old)
            gens.append(gen)
        f, gen = Found.join(parts), np.concatenate(gens)
        order = _sorted(f, gen)
        f, gen = f.take(order), gen[order]
        differs = lambda *cols: np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
        new_a = differs(f.anchor)
        new_s = differs(f.anchor, f.content, f.n, f.check)  # the fingerprints agree and so do the checks
        of_a = np.cumsum(new_a) - 1
        fresh = gen == generation
        open_a = np.bincount(of_a[new_s]) > 1
        later = fresh & ~new_s
        start, n, times = (c.astype(np.int64) for c in (f.start, f.n, f.times))
        more = fresh & new_s & (times > 1)  # a first place whose own repetitions follow it
        begin = np.r_[start[later], start[more] + n[more]]
        end = np.r_[(start + times * n)[later], (start + times * n)[more]] - 1 + spec.span
        rows = passing + span_rows(REMOVE, np.r_[f.rid[later], f.rid[more]], begin, end, n_buckets)
        o = new_s & open_a[of_a]
        rows += rep_rows(OPEN, f.rid[o], f.start[o], f.n[o], gen[o].astype(np.uint32), n_buckets=n_buckets)
        keep = fresh & new_s
        rows += _run_rows(bucket, f.take(keep), gen[keep])
        return payload_table(rows, ("kind", "bucket", "payload"))

    return run


def _merged_runs(table: pa.Table) -> pa.Table:
    """All runs of a bucket as one sorted run; they are disjoint, as a run has only what no earlier one had."""
    parts = [_run_of(x.as_py()) for x in table.column("payload")]
    f, gen = Found.join([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = _sorted(f, gen)
    return payload_table([(table.column("bucket")[0].as_py(), _run_payload(f.take(order), gen[order]))], ("bucket", "payload"))


class FingerprintIndex:
    """Sorted immutable runs in one table in files by bucket; add() takes batches in order.

    path: the folder of the runs, by default in the scratch folder.  The number of
    buckets is fixed when an index is made: a bucket's runs are one task's memory.
    """

    def __init__(self, spark: SparkSession, spec: Spec, n_buckets: int, fan_in: int = 4, path: str | None = None) -> None:
        self.spark, self.spec, self.n_buckets, self.fan_in = spark, spec, n_buckets, fan_in
        self.root = path or scratch(spark, "fingerprints")
        self.runs = self.generations = self.versions = 0
        self.name = self._new_name()

    def _new_name(self) -> str:
        return f"ls_runs_{uuid.uuid4().hex}"

    def _folder(self) -> str:
        return f"{self.root}/runs-{self.versions}"

    def add(self, docs: DataFrame) -> DataFrame:
        """(kind, bucket, payload) of a batch of (RID, text): what it repeats and what must be compared further."""
        new = docs.select(RID, "text").mapInArrow(superwindow_blobs(self.spec, self.n_buckets), KINDED)
        old = self.spark.table(self.name) if self.runs else self.spark.createDataFrame([], BLOB)
        merged = new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_merge(self.spec, self.n_buckets, self.generations), KINDED)
        out = spill(merged, "merged", "kind").select("kind", "bucket", "payload")
        self._write(only(out, RUN).select("bucket", "payload").repartition(self.n_buckets, "bucket"))
        self.runs += 1
        self.generations += 1
        if self.runs > self.fan_in:
            self.compact()
        return out

    def _write(self, run: DataFrame) -> None:
        """Adds a run's files."""
        run.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(self.n_buckets, "bucket").option("path", self._folder()).saveAsTable(self.name)

    def compact(self) -> None:
        """Merges all runs into one sorted run, bucket by bucket where they are."""
        if not self.runs:
            return
        merged = self.spark.table(self.name).groupBy("bucket").applyInArrow(_merged_runs, BLOB)
        name, folder = self.name, self._folder()
        self.name, self.versions = self._new_name(), self.versions + 1
        self._write(merged)
        self.runs = 1
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, folder)

    def save(self) -> str:
        """Writes what open() needs beside the runs, and returns the folder."""
        about = (self.spec.kind, self.spec.span, self.spec.gram, self.n_buckets, self.fan_in, self.runs, self.generations, self.versions)
        self.spark.createDataFrame([about], _ABOUT).coalesce(1).write.mode("overwrite").json(f"{self.root}/about")
        return self.root

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """A saved index; its batches go on where it ended."""
        x = spark.read.schema(_ABOUT).json(f"{path}/about").first()
        index = cls(spark, Spec(x.kind, x.span, x.gram), x.n_buckets, x.fan_in, path)
        index.runs, index.generations, index.versions = x.runs, x.generations, x.versions
        if index.runs:
            spark.sql(f"CREATE TABLE {index.name} (bucket BIGINT, payload BINARY) USING parquet CLUSTERED BY (bucket) INTO {x.n_buckets} BUCKETS LOCATION '{index._folder()}'")
        return index

    def close(self, delete: bool = False) -> None:
        """Forgets the table; delete: and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            remove(self.spark, self.root)


_ABOUT = "kind string, span int, gram int, n_buckets long, fan_in int, runs int, generations int, versions int"


def _window_blobs(spec: Spec, n_buckets: int):
    """For mapInArrow over (RID, text, payload): two hashes of every single window of open superwindows, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*have, strict=True)]
            have.clear()
            bucket = (cols[0] % ts.U(n_buckets)).astype(np.int64)
            return payload_batch([(b, pack(h, c, delta(r), s.astype(np.uint32), g)) for b, (h, c, r, s, g) in split_by(bucket, *cols)])

        for batch, buf, off in text_chunks(batches):
            payloads = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            parts = [(i, *unpack(x, "u4", "u1", "u4")) for i, x in enumerate(payloads) if x]
            if not parts:
                continue
            ws, we, items = ts.words(buf, off, ts.SPACED)
            one, two = ts.prefix(ts.word_hashes(buf, ws, we)), ts.prefix(ts.word_hashes(buf, ws, we, other=True), ts.BASE_B)
            doc = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
            start, n, gen = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2, 3))
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc, gen = np.repeat(doc, n), np.repeat(gen, n)
            abs_at = items[doc] + at
            have.append((ts.spans(one, abs_at, abs_at + spec.span), ts.spans(two, abs_at, abs_at + spec.span, ts.BASE_B), column(batch, RID)[doc], at, gen.astype(np.uint32)))
            if sum(len(h[0]) for h in have) > 1_000_000:
                yield flush()
        if have:
            yield flush()

    return run


def _first_windows(spec: Spec, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "u8", "u8", "i8", "u4", "u4") for x in table.column("payload").to_pylist()]
        h, c, rid, start, gen = (np.concatenate(x) for x in zip(*([p[0], p[1], np.cumsum(p[2]), p[3], p[4]] for p in parts), strict=True))
        order = np.lexsort((start, rid, gen, c, h))
        h, c, rid, start = h[order], c[order], rid[order], start[order].astype(np.int64)
        later = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
        return payload_table(span_rows(REMOVE, rid[later], start[later], start[later] + spec.span, n_buckets), ("kind", "bucket", "payload"))

    return run


def repeated_words(docs: DataFrame, span: int = 20, gram: int = 6, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(RID, payload): stretches of words covered by windows that also start earlier; docs from identify().

    The documents enter the index in ``batches`` batches of ascending row numbers; as
    there are more of them than ``fan_in``, the runs are compacted on the way.
    """
    index = FingerprintIndex(docs.sparkSession, Spec("words", span, gram), buckets_for(text_bytes(docs)), fan_in)
    with temporary(docs.sparkSession):
        try:
            low, high = docs.agg(F.min(RID), F.max(RID)).first()
            parts: list[DataFrame] = []
            if low is not None:
                bounds = docs.agg(F.percentile_approx(RID, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
                edges = [low, *sorted(set(b for b in bounds if low < b <= high)), high + 1]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    parts.append(index.add(docs.filter((F.col(RID) >= a) & (F.col(RID) < b))))
            else:
                parts.append(index.add(docs))
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            return spill(to_remove(docs, index, found), "words-spans", keep=True)
        finally:
            index.close(delete=True)


def to_remove(docs: DataFrame, index: FingerprintIndex, found: DataFrame) -> DataFrame:
    """(RID, payload): the stretches to remove of documents whose add() found this; docs: they and all indexed documents that they may share windows with."""
    reps = spill(reps_per_document(only(found, OPEN), "u4", "u1", "u4"), "words-open")
    windows = attach(docs.select(RID, "text"), reps, how="inner").mapInArrow(_window_blobs(index.spec, index.n_buckets), BLOB)
    second = windows.groupBy("bucket").applyInArrow(_first_windows(index.spec, index.n_buckets), KINDED)
    return per_document(only(found, REMOVE).unionByName(second))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in text_chunks(batches):
        n_words, n_removed, kept = [], [], []
        for i, payload in enumerate(batch.column(batch.schema.get_field_index("payload")).to_pylist()):
            words = buf[off[i] : off[i + 1]].tobytes().split()
            start, end = spans_of(payload)
            n_words.append(len(words))
            n_removed.append(int((end.astype(np.int64) - start).sum()))
            for s, e in zip(start[::-1].tolist(), end[::-1].tolist(), strict=True):
                del words[s:e]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(RID)), batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            names=[RID, "doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeated_words(docs: DataFrame, span: int = 20, gram: int = 6, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word goes that a window of ``span`` words covers which also starts earlier.

    kept: the remaining words joined by one space.
    """
    docs = identify(docs, id_col, text_col)
    spans = repeated_words(docs, span, gram, batches)
    return kept_texts(attach(docs, spans)).drop(RID)


def kept_texts(rows: DataFrame) -> DataFrame:
    """(RID, doc_id, n_words, n_removed, kept) of texts with the stretches of words to remove (payload, may be null)."""
    return rows.select(RID, "doc_id", "text", "payload").mapInArrow(_keep, f"{RID} long, doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256)).drop("kept")


__all__ = ["FingerprintIndex", "digest", "remove_repeated_words", "repeated_words", "to_remove"]
