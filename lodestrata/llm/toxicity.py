"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

Features are presences of words and of word beginnings (4, 5 and 6 bytes), known by
64-bit hashes.  Those of a sample that are clearly more frequent in grades above 0
are kept (the ``features`` most associated ones).  Their weights are not negative,
so that a long text's ordinary words can't outweigh what it also says, and are
shared by all grades; one ordered threshold per grade border turns the score of a text into probabilities:
P(grade <= k) = sigmoid(threshold_k - score).  The expected severity is the sum of
P(grade > k).

The model is fitted on a bounded sample of labelled rows: of graded-0 rows and of
the others the ``per_class`` with the smallest hashes of their ids.  Scoring covers
every word of every document.

Labels that only say toxic or not are refined into grades 0, 1 and 2 by what other
texts teach: the sample is halved by a hash of ids, and toxic texts are ordered by how
many of the features they have that only toxic texts of the *other* half have; the
upper part, about half, is of grade 2.  No text's grade rests on features that were taken from it, so a
word that stands in one toxic text alone raises no grade.

Nulls and empty texts have no features and get the severity of the thresholds;
repeated rows are scored each for itself; labels that are null, or of unknown or
null ids, are not used, and of several labels of an id the highest counts; where no
labelled documents of both kinds are left (empty tables, labels of one kind), or no
feature tells them apart, the model has no features and gives every text grade 0; an
empty table of documents gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import RID, attach, column, numbered, original, spill, temporary, text_chunks

_HEADS = (4, 5, 6)


def features_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of every word of a chunk (words, then their beginnings) with document numbers; and words per document."""
    low = ts.LOWER[buf]
    ws, we, items = ts.words(low, off, ts.ALNUM)
    pre = ts.prefix(ts.BYTE_A[low])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(items))
    parts, docs = [ts.spans(pre, ws, we)], [doc]
    for n in _HEADS:
        m = we - ws >= n
        parts.append(ts.spans(pre, ws[m], ws[m] + n) * ts.ODD[n] + ts.U(n))
        docs.append(doc[m])
    return np.concatenate(parts), np.concatenate(docs), np.diff(items)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, off in text_chunks(batches):
        h, doc, n = features_of(buf, off)
        d, u = _distinct(doc, h)
        border = np.searchsorted(d, np.arange(len(n) + 1))
        data = [u[a:b].tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("grade", "half")), pa.array(data, pa.binary())], names=["grade", "half", "features"])


#: For each half of the sample: texts of upper grades and others that have a feature.
_COUNTS = ("high0", "low0", "high1", "low1")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.frombuffer(x, np.int64) for x in batch.column(batch.schema.get_field_index("features")).to_pylist()]
        if not len(raw):
            continue
        kind = np.repeat(2 * column(batch, "half") + (column(batch, "grade") == 0), [len(x) for x in raw])
        u, inv = np.unique(np.concatenate(raw), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), *(pa.array(np.bincount(inv[kind == k], minlength=len(u))) for k in range(4))], names=["feature", *_COUNTS])


@dataclass
class Model:
    """features: sorted hashes; weights: one each, shared by all grades; thresholds: ascending, one per border of grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.features & ts.U((1 << 18) - 1)).astype(np.int64)] = True

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of the weights of the features that each document of a chunk has."""
        if not len(self.features):
            return np.zeros(len(off) - 1)
        h, doc, _ = features_of(buf, off)
        m = self.maybe[(h & ts.U((1 << 18) - 1)).astype(np.int64)]
        doc, h = _distinct(doc[m], h[m])
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = self.features[at] == h
        return np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=len(off) - 1).astype(np.float64)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each border k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, rounds: int = 1000, ridge: float = 1e-5, step: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of a cumulative-link model of presences (row, col) by AdaGrad on the mean log-likelihood.

    Thresholds are the first one plus positive gaps (kept as logarithms), so they stay ordered.
    """
    n, k = len(grade), int(grade.max())
    w, first, gaps = np.zeros(n_features), 0.0, np.zeros(k - 1)
    total = [np.full(n_features, 1e-8), np.full(1, 1e-8), np.full(k - 1, 1e-8)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        theta = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        s = np.bincount(row, weights=w[col], minlength=n)
        upper = np.where(grade < k, sigmoid(theta[np.minimum(grade, k - 1)] - s), 1.0)
        lower = np.where(grade > 0, sigmoid(theta[np.maximum(grade - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # slopes of log p at the two borders
        g_theta = np.bincount(np.minimum(grade, k - 1)[grade < k], weights=du[grade < k], minlength=k) - np.bincount(np.maximum(grade - 1, 0)[grade > 0], weights=dl[grade > 0], minlength=k)
        g_s = dl - du
        grads = [np.bincount(col, weights=g_s[row], minlength=n_features) / n - ridge * w, np.array([g_theta.sum() / n]), np.array([g_theta[j + 1 :].sum() * np.exp(gaps[j]) / n for j in range(k - 1)])]
        for t, g in zip(total, grads, strict=True):
            t += g * g
        w = np.maximum(w + step * grads[0] / np.sqrt(total[0]), 0.0)
        first += float(step * grads[1][0] / np.sqrt(total[1][0]))
        gaps = gaps + step * grads[2] / np.sqrt(total[2]) if k > 1 else gaps
    return w, first + np.r_[0.0, np.cumsum(np.exp(gaps))]


#: A model that knows nothing: grade 0 for every text.
UNKNOWN = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, features: int = 4096, least: int = 5, least_chi: float = 15.0, lift: float = 20.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", graded: bool = False) -> Model:
    """A model from at most 2 * per_class labelled rows; graded: label_col already has ordered grades from 0 on."""
    rows = numbered(docs, id_col, text_col)
    with temporary(docs.sparkSession):
        known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("grade")).filter("id is not null and grade is not null")
        known = known.groupBy("id").agg(F.max("grade").alias("grade"))
        drawn = lambda df, key: df.filter("grade = 0").orderBy(F.xxhash64(key), key).limit(per_class).unionByName(df.filter("grade > 0").orderBy(F.xxhash64(key), key).limit(per_class))
        half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")
        ids = spill(drawn(known, "id").select("id", "grade", half), "label-sample")  # at most 2 * per_class rows of three numbers: broadcast
        # an id may have any number of rows, so rows are drawn from those of the ids, again at most 2 * per_class
        labelled = rows.select(RID, F.col(id_col).cast("long").alias("id")).join(F.broadcast(ids), "id").drop("id")
        sample = spill(drawn(labelled, RID), "row-sample")
        texts = rows.select(RID, F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), RID).select("grade", "half", "text")
        found = spill(texts.mapInArrow(_sample_features, "grade int, half int, features binary"), "sample-features")
        return _fitted(found, features, least, least_chi, lift, graded)


def _fitted(found: DataFrame, features: int, least: int, least_chi: float, lift: float, graded: bool) -> Model:
    """The model of a sample (grade, half, features)."""
    counts = {bool(r[0]): r[1] for r in found.groupBy(F.col("grade") > 0).count().collect()}
    if len(counts) < 2:
        return UNKNOWN
    n_high, n_low = counts[True], counts[False]
    frequent = found.mapInArrow(_frequencies, "feature long, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    frequent = frequent.withColumn("high", F.expr("high0 + high1")).withColumn("low", F.expr("low0 + low1")).filter(F.col("high") + F.col("low") >= least)
    # chi-square of presence against grade > 0
    a, b = F.col("high").cast("double"), F.col("low").cast("double")
    chi = F.pow(a * (n_low - b) - b * (n_high - a), F.lit(2)) / ((a + b) * (F.lit(float(n_high + n_low)) - a - b + 1))
    risen = a * n_low >= lift * b * n_high  # so many times as frequent in the upper grades
    best = frequent.withColumn("chi", chi).filter((F.col("chi") >= least_chi) & risen).orderBy(F.desc("chi"), "feature").limit(features).collect()
    if not best:
        return UNKNOWN
    as_hashes = lambda rows: np.array(sorted(np.int64(r.feature).view(np.uint64) for r in rows), np.uint64)
    chosen = as_hashes(best)
    # what only toxic texts of the other half have, for each half
    alone = [as_hashes(r for r in best if r.high1 and not r.low1), as_hashes(r for r in best if r.high0 and not r.low0)]

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, count = [], []
            for half, x in zip(column(batch, "half").tolist(), batch.column(batch.schema.get_field_index("features")).to_pylist(), strict=True):
                h = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
                data.append(at[chosen[at] == h].astype(np.int32).tobytes())
                count.append(int(np.isin(h, alone[half]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("grade")), pa.array(count, pa.int64()), pa.array(data, pa.binary())], names=["grade", "alone", "at"])

    taken = found.mapInArrow(restricted, "grade int, alone long, at binary").collect()  # at most 2 * per_class rows
    grade = np.array([r.grade for r in taken], np.int64)
    if not graded:
        strength = np.array([r.alone for r in taken])
        bad = grade > 0
        # the border that parts the toxic texts most evenly; none if all are alike
        borders = np.unique(strength[bad])[:-1]
        uneven = [abs(float((strength[bad] > x).mean()) - 0.5) for x in borders]
        grade = np.minimum(grade, 1) + (bad & (strength > borders[int(np.argmin(uneven))]) if len(borders) else 0)
    cols = [np.frombuffer(r.at, np.int32) for r in taken]
    order = np.lexsort(([len(c) for c in cols], [int(c.sum()) for c in cols], grade))  # the same sums on every run
    row = np.repeat(np.arange(len(cols)), [len(cols[i]) for i in order])
    w, theta = fit_ordinal(row, np.concatenate([cols[i] for i in order]).astype(np.int64), grade[order], len(chosen))
    return Model(chosen, w, theta)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, score, expected_severity, p_toxic, grade, rejected) per row; rejected: grade 0 is less likely than not."""
    features, weights, thresholds = model.features, model.weights, model.thresholds
    name = key or "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(features, weights, thresholds)
        for batch, buf, off in text_chunks(batches):
            s = np.round(own.scores(buf, off), 9)
            above = own.above(s)
            mass = np.c_[np.ones(len(s)), above] - np.c_[above, np.zeros(len(s))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array(np.round(above.sum(axis=1), 6)), pa.array(np.round(above[:, 0], 6)), pa.array(mass.argmax(axis=1)), pa.array(above[:, 0] > 0.5)],
                names=[name, "score", "expected_severity", "p_toxic", "grade", "rejected"],
            )

    texts = docs.select(F.col(key or id_col).cast("long").alias(name), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"{name} long, score double, expected_severity double, p_toxic double, grade long, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that a model fitted on labels rejects; all columns stay."""
    rows = numbered(docs, id_col, text_col)
    model = fit(rows, labels, id_col=id_col, text_col=text_col)
    gone = spill(score(rows, model, text_col=text_col, key=RID).filter("rejected").select(RID, F.lit(b"").alias("payload")), "toxic")
    return original(attach(rows, gone, how="left_anti"), docs)
