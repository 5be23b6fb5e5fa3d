"""Phrases whose words stand together more often than apart, from suffix automata of shards.

A *shard* is some megabytes of text.  Its generalised suffix automaton over words,
bounded to ``depth`` words, is built level by level in columns: the phrases of k words
that end at each place get class numbers, those of k words being (k - 1 words, next
word), so classes are in the order of their words.  A class has the number of its end
places and a suffix link, the class without the first word; where both numbers are
equal the two have the same end places and are one state.  Enumerating the states
gives every phrase of the shard once with its number of places.

What travels are these phrases with their counts, compressed, by bucket of a hash of
their words; a bucket adds up counts by language and the phrases themselves, not
their hashes, and keeps those with at least ``least`` places.  Every part of such a
phrase has at least as many, so scores are joins of what is kept with itself, and a
longer phrase subsumes what its suffix link, or the same link read from the other
side, leads to.  Ranks come from one sort by ranges, so a language may be as large as
it likes.

A null text is empty, a null language ``und``; every row is a document, whether ids
repeat or are missing; texts without words add nothing; an empty table gives an empty
result; extra columns are ignored, whatever their names.  Equal scores are ordered by
number of places, then by the phrase's bytes, so no two ranks tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import bound_batches, buckets_for, payload_batch, spill, split_by, temporary, text_bytes, text_chunks

#: Bytes that end a piece, ``[.,;:!?\x0A-\x0D]``, and bytes of words, all but those and ``[\x20\x09]``.
BREAK = ~ts.byte_class(".,;:!?\n\v\f\r")
WORD = ts.byte_class(".,;:!?\n\v\f\r \t")
#: Words of a shard.
SHARD = 300_000


@dataclass
class Level:
    """Phrases of one length: the class that ends at each place (-1: none), and per class one of its end places, its number of places and its suffix link."""

    ends: np.ndarray
    example: np.ndarray
    places: np.ndarray
    link: np.ndarray


def _level(keys: np.ndarray, valid: np.ndarray, shorter: np.ndarray | None, total: int) -> Level:
    at = np.flatnonzero(valid)
    _, first, number, places = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    ends = np.full(total, -1, np.int64)
    ends[at] = number
    example = at[first]
    return Level(ends, example, places, np.full(len(first), -1) if shorter is None else shorter[example])


class SuffixAutomaton:
    """The bounded automaton of a shard's pieces.  words: a number per word; fresh: whether it begins a piece; kind: languages, which share nothing."""

    def __init__(self, words: np.ndarray, fresh: np.ndarray, kind: np.ndarray, depth: int) -> None:
        total = len(words)
        base = int(words.max()) + 1 if total else 1
        one = _level(kind * base + words, np.ones(total, bool), None, total)
        self.levels = [one]
        for _ in range(1, depth):
            shorter = self.levels[-1].ends
            valid = ~fresh
            valid[1:] &= shorter[:-1] >= 0
            valid[:1] = False
            at = np.flatnonzero(valid)
            self.levels.append(_level(shorter[at - 1] * len(one.places) + one.ends[at], valid, shorter, total))

    def states(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length k: the classes that are the longest phrase of their state, and the shortest length in it."""
        out, joined = [], np.zeros(0, np.int64)
        for k in range(len(self.levels), 0, -1):
            level = self.levels[k - 1]
            longest = np.ones(len(level.places), bool)
            longest[joined] = False  # its end places are those of a longer phrase
            heads = np.flatnonzero(longest)
            shortest, at, n = np.full(len(heads), k), heads, level.places[heads]
            for j in range(k - 1, 0, -1):
                at = np.where(at >= 0, self.levels[j].link[at], -1)  # where the chain has ended it stays so
                same = (at >= 0) & (self.levels[j - 1].places[at] == n)
                at = np.where(same, at, -1)
                shortest[same] = j
                if not same.any():
                    break
            out.append((heads, shortest))
            joined = level.link[(level.link >= 0) & (level.places == self.levels[k - 2].places[level.link])] if k > 1 else joined
        return out[::-1]

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, end places of one occurrence, numbers of places) of all phrases, state by state."""
        for longest, (heads, shortest) in enumerate(self.states(), 1):
            level = self.levels[longest - 1]
            for k in range(longest, 0, -1):
                held = heads[shortest <= k]
                if len(held):
                    yield k, level.example[held], level.places[held]


def _dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _shard_blobs(depth: int, n_buckets: int, shard: int):
    """For mapInArrow over (lang, text): blobs (bucket, payload) of shards' phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        have: list[tuple] = []

        def flush() -> pa.RecordBatch:
            data, sizes, fresh, kind = (np.concatenate(c) for c in zip(*have, strict=True))
            have.clear()
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
            names = coded.dictionary.take(pa.array(order))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            word = place[coded.indices.to_numpy()]
            raw, off = np.frombuffer(names.buffers()[2] or b"", np.uint8), np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
            h = ts.word_hashes(raw, off[:-1], off[1:])
            parts, buckets = [], []
            for k, end, places in SuffixAutomaton(word, fresh, kind, depth).phrases():
                at = [word[end - j] for j in range(k - 1, -1, -1)]
                text = pc.binary_join_element_wise(*(names.take(pa.array(w)) for w in at), pa.scalar(b" ", pa.large_binary()))
                parts.append(pa.table({"lang": pa.array(kind[end].astype(np.int32)), "phrase": text, "size": pa.array(np.full(len(end), k, np.int8)), "n": pa.array(places.astype(np.int64))}))
                mixed = ts.mix(sum((h[w] * ts.ODD[j] for j, w in enumerate(at)), np.zeros(len(end), np.uint64)))
                buckets.append((mixed % ts.U(n_buckets)).astype(np.int64))
            # the words of each language, under a phrase of no words
            used, n = np.unique(kind, return_counts=True)
            parts.append(pa.table({"lang": pa.array(used.astype(np.int32)), "phrase": pa.array([b""] * len(used), pa.large_binary()), "size": pa.array(np.zeros(len(used), np.int8)), "n": pa.array(n.astype(np.int64))}))
            buckets.append(np.zeros(len(used), np.int64))
            whole = pa.concat_tables(parts).combine_chunks()
            named = pa.array(list(langs), pa.string())
            rows = []
            for b, (at,) in split_by(np.concatenate(buckets), np.arange(whole.num_rows)):
                own = whole.take(pa.array(at))
                rows.append((b, _dump(own.set_column(0, "lang", pa.DictionaryArray.from_arrays(own["lang"].combine_chunks(), named)))))
            return payload_batch(rows)

        for batch, buf, off in text_chunks(batches):
            kind = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
            buf = ts.LOWER[buf]
            start, end, border = ts.words(buf, off, WORD)
            if not len(start):
                continue
            breaks = np.cumsum(BREAK[buf], dtype=np.int64)[start]
            fresh = np.r_[True, breaks[1:] != breaks[:-1]]
            fresh[border[:-1][border[:-1] < len(start)]] = True
            have.append((buf[WORD[buf]], end - start, fresh, np.repeat(kind, np.diff(border))))
            if sum(len(x[1]) for x in have) > shard:
                yield flush()
        if have:
            yield flush()

    return run


def _reduced(least: int):
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for payload in table.column("payload"):
            part = pa.ipc.open_stream(payload.as_py()).read_all()
            parts.append(part.set_column(0, "lang", part["lang"].cast(pa.string())))
        found = pa.concat_tables(parts).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
        found = found.filter(pc.or_(pc.equal(found["size"], 0), pc.greater_equal(found["n_sum"], least)))
        return pa.table({"lang": found["lang"], "phrase": found["phrase"].cast(pa.large_string()).cast(pa.string()), "size": found["size"].cast(pa.int32()), "n": found["n_sum"]})

    return run


def frequent(docs: DataFrame, least: int = 10, depth: int = 3, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of at most ``depth`` words with at least ``least`` places; size 0: all words of the language."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    n_buckets = buckets_for(text_bytes(rows), each=4 << 20, least=24)
    blobs = rows.mapInArrow(_shard_blobs(depth, n_buckets, shard), "bucket long, payload binary")
    return blobs.groupBy("bucket").applyInArrow(_reduced(least), "lang string, phrase string, size int, n long")


def scored(counts: DataFrame, inside: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one subsumes; counts from frequent().

    The lowest-scoring cut counts, of equals the earliest; inside: percent of a
    candidate's places that must lie in one longer candidate for it to go.
    """
    words = F.split("phrase", " ", -1)
    candidates = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    sides = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("rest"))
    parts = counts.filter("size > 0").select("lang", "phrase", "n")
    left, right = parts.toDF("lang", "first", "l"), parts.toDF("lang", "rest", "r")
    both = sides.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = {c: f"cast({c} AS decimal(19, 0))" for c in "alr"}
    score = F.expr(f"1000000 * ({exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")
    worst = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("s"))
    # what a longer phrase's suffix link leads to, and the link from its other side
    linked = candidates.filter("size > 2").select("lang", F.explode(F.array(*(F.array_join(F.slice("w", i, F.size("w") - 1), " ") for i in (2, 1)))).alias("phrase"), "a")
    longer = linked.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("s.a")))
    return left.select("lang", "phrase", *(F.col(f"s.{c}").alias(c) for c in ("a", "l", "r", "score")))


def ranked(rows: DataFrame, most: int, *order) -> DataFrame:
    """rows with ``rank`` within lang by ``order``, up to ``most``: one sort by ranges, then the ranges' numbers of rows, so no task has a language."""
    placed = rows.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    placed = spill(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ordered", keep=True)
    ranges = placed.groupBy("lang", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("lang").orderBy("__part")) - F.col("__n")
    ranges = ranges.withColumn("__before", before).filter(F.col("__before") < most).drop("__n")
    out = placed.join(ranges, ["lang", "__part"]).withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return out.filter(F.col("rank") <= most).drop("__part", "__at", "__first", "__before")


def mine(docs: DataFrame, least: int = 10, inside: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words."""
    with temporary(docs.sparkSession):
        counts = spill(frequent(docs, least, 3, text_col, lang_col, shard), "phrases")
        totals = spill(counts.filter("size = 0").select("lang", "n"), "words", keep=True)
        best = ranked(scored(counts, inside), most, F.desc("score"), F.desc("a"), F.col("phrase"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
