"""Which words part the sources of a language: an audit by mergeable radix tries.

Each task counts the terms of its documents in a radix trie over their bytes; a leaf
has a counter per (language, source) and the number of documents per language that
have the term.  A full trie is written as its leaves in byte order, which is UTF-8
order.  Tries are merged by *prefix ranges*: stretches of that order which hold about
equally many counters, found by counting prefixes, longer ones wherever one prefix
holds too much.  A merged range is a trie again; a traversal of it gives the terms of
each language that enough documents have, in order.

From these counts and the totals of each group follow the smoothed shares, in whole
numbers.  A traversal then streams, for every pair of sources, the sum of their
differences over the range, and for every group its best terms, of which equal ones
come in the order of the traversal; sums of ranges add up, and the best of the ranges'
best are the best.

Null texts, languages and sources count as ''; every row is a document, whether ids
repeat or are missing; a group without terms has pairs of value 0 where its language
keeps none; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import bound_batches, spill, temporary, text_chunks

#: Bytes of words ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
LETTERS = np.ones(256, bool)
LETTERS[0x00:0x61] = LETTERS[0x7B:0x80] = False
#: Bytes of text that are counted at once, leaves of a trie before it is written, counters that a merged range should have.
CHUNK, LEAVES, RANGE = 2 << 20, 600_000, 400_000
#: Sources of a language that one task compares with all others, and cells of a table of shares.
BLOCK, CELLS = 256, 4 << 20
#: Bytes of the prefixes that ranges are made of, more where one has too much.
FIRST_BYTES = 3
_TRIE = "terms binary, counts binary, spread binary"


class RadixTrie:
    """Terms as paths of byte strings; each has a leaf number in the order of its arrival."""

    def __init__(self) -> None:
        self.label: list[bytes] = [b""]
        self.below: list[dict[int, int]] = [{}]
        self.leaf: list[int] = [-1]
        self.leaves = 0

    def _node(self, label: bytes, below: dict[int, int], leaf: int) -> int:
        self.label.append(label)
        self.below.append(below)
        self.leaf.append(leaf)
        return len(self.label) - 1

    def put(self, term: bytes) -> int:
        """The leaf of a term, a new one if need be."""
        at, read, size = 0, 0, len(term)
        while read < size:
            nodes = self.below[at]
            child = nodes.get(term[read])
            if child is None:
                nodes[term[read]] = self._node(term[read:], {}, self.leaves)
                self.leaves += 1
                return self.leaves - 1
            label = self.label[child]
            if term.startswith(label, read):
                at, read = child, read + len(label)
                continue
            same = 1
            while read + same < size and same < len(label) and label[same] == term[read + same]:
                same += 1
            parted = self._node(label[:same], {label[same]: child}, -1)
            self.label[child] = label[same:]
            nodes[term[read]] = parted
            at, read = parted, read + same
        if self.leaf[at] < 0:
            self.leaf[at] = self.leaves
            self.leaves += 1
        return self.leaf[at]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in byte order."""
        stack = [(0, b"")]
        while stack:
            at, path = stack.pop()
            path += self.label[at]
            if self.leaf[at] >= 0:
                yield path, self.leaf[at]
            below = self.below[at]
            for first in sorted(below, reverse=True):
                stack.append((below[first], path))


def _dump(**columns) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _load(data: bytes) -> list:
    return [c.combine_chunks() for c in pa.ipc.open_stream(data).read_all().columns]


def _numbers(data: bytes) -> list[np.ndarray]:
    return [c.to_numpy() for c in _load(data)]


def _summed(leaf: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters by (leaf, other), in that order, equal ones added up."""
    if not len(leaf):
        return leaf, other, n
    order = np.lexsort((other, leaf))
    leaf, other, n = leaf[order], other[order], n[order]
    first = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (other[1:] != other[:-1])])
    return leaf[first], other[first], np.add.reduceat(n, first)


class Counters:
    """A trie, and counters of its leaves: occurrences per group and documents per language."""

    def __init__(self) -> None:
        self.trie = RadixTrie()
        self.known: dict[bytes, int] = {}
        self.counts: list[tuple] = []
        self.spread: list[tuple] = []

    def leaves(self, terms: list[bytes]) -> np.ndarray:
        """The leaves of distinct terms; those that came before are remembered."""
        known, put, out = self.known, self.trie.put, []
        for t in terms:
            leaf = known.get(t)
            if leaf is None:
                leaf = known[t] = put(t)
            out.append(leaf)
        return np.array(out, np.int64)

    def written(self) -> tuple[pa.Array, tuple, tuple]:
        """(terms in byte order, counters, documents), leaves numbered in that order."""
        walked = list(self.trie.walk())
        place = np.empty(len(walked), np.int64)
        place[[leaf for _, leaf in walked]] = np.arange(len(walked))
        out = []
        for rows in (self.counts, self.spread):
            leaf, other, n = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 3
            out.append(_summed(place[leaf], other, n))
        return pa.array([t for t, _ in walked], pa.large_binary()), *out


def _numbered(values: list, known: dict) -> np.ndarray:
    return np.array([known.setdefault(v, len(known)) for v in values], np.int64)


def _counted(leaves: int):
    """For mapInArrow over (lang, source, text): tries of about so many leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, groups, langs = Counters(), {}, {}
        lang_of: list[int] = []

        def flush() -> pa.RecordBatch:
            terms, counts, spread = have.written()
            named = pa.array([{"lang": a, "source": b} for a, b in groups], pa.struct([("lang", pa.string()), ("source", pa.string())]))
            blobs = [_dump(term=terms), _dump(leaf=counts[0], group=counts[1], n=counts[2]), _dump(leaf=spread[0], lang=spread[1], n=spread[2])]
            sets = [pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named), pa.array([list(langs)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in blobs), *sets], names=["terms", "counts", "spread", "groups", "langs"])

        for batch, buf, off in text_chunks(batches, CHUNK):
            of_doc = [(a or "", b or "") for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            group = _numbered(of_doc, groups)
            for a, _ in list(groups)[len(lang_of) :]:
                lang_of.append(langs.setdefault(a, len(langs)))
            buf = ts.LOWER[buf]
            start, end, border = ts.words(buf, off, LETTERS)
            if not len(start):
                continue
            # the words' bytes end to end, as distinct terms and their numbers
            data, ends = buf[LETTERS[buf]], np.r_[0, np.cumsum(end - start)]
            words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
            term, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            leaf = have.leaves(words.dictionary.to_pylist())
            doc = np.repeat(np.arange(len(group)), np.diff(border))
            key, n = np.unique(group[doc] * size + term, return_counts=True)
            have.counts.append((leaf[key % size], key // size, n))
            once = np.unique(doc * size + term)
            key, n = np.unique(np.array(lang_of, np.int64)[group[once // size]] * size + once % size, return_counts=True)
            have.spread.append((leaf[key % size], key // size, n))
            if have.trie.leaves > leaves or sum(len(c[0]) for c in have.counts) > 4 * leaves:
                yield flush()
                have = Counters()
        yield flush()

    return run


def _prefixes(depth: int, within: list[bytes]):
    """Counters of tries by the first ``depth`` bytes of terms that begin with one of some prefixes of one byte less (none given: all terms)."""
    parents = pa.array(within, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                names, leaf = _load(terms.as_py())[0], _numbers(counts.as_py())[0]
                n = np.bincount(leaf, minlength=len(names))
                if within:
                    inside = pc.is_in(pc.binary_slice(names, 0, depth - 1), parents)
                    names, n = names.filter(inside), n[inside.to_numpy(zero_copy_only=False)]
                coded = pc.binary_slice(names, 0, depth).dictionary_encode()
                summed = np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)
                for t, k in zip(coded.dictionary.to_pylist(), summed.tolist(), strict=True):
                    found[t] = found.get(t, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["prefix", "n"])

    return run


def _range_cuts(tries: DataFrame, most: int = RANGE, least: int = 16) -> list[bytes]:
    """Where ranges begin, but for the first: each has about ``most`` counters, or one term.

    The driver sees prefixes, no terms: those of FIRST_BYTES bytes, at most some hundred
    thousand, and of each that has more than a range's counters those of one byte more.
    """
    weight: dict[bytes, int] = {}
    heavy, depth = [], FIRST_BYTES
    while heavy or not weight:
        rows = tries.select("terms", "counts").mapInArrow(_prefixes(depth, heavy), "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect()
        if not rows:
            break
        if depth == FIRST_BYTES:
            most = max(1, min(most, sum(r["n"] for r in rows) // least))
        for p in heavy:
            weight.pop(p, None)
        weight |= {bytes(r["prefix"]): r["n"] for r in rows}
        heavy = [bytes(r["prefix"]) for r in rows if r["n"] > most and len(r["prefix"]) == depth]
        depth += 1
    cuts, have = [], 0
    for p in sorted(weight):
        if have and have + weight[p] > most:
            cuts.append(p)
            have = 0
        have += weight[p]
    return cuts


def _cut(cuts: list[bytes]):
    """Tries in parts by range, under (range, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for terms, counts, spread, groups, langs in zip(*batch.columns, strict=True):
                names, counters, docs = _load(terms.as_py())[0], _numbers(counts.as_py()), _numbers(spread.as_py())
                listed = names.to_pylist()
                at = [0, *(bisect.bisect_left(listed, c) for c in cuts), len(listed)]
                for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if a == b:
                        continue
                    parts = []
                    for leaf, *rest in (counters, docs):
                        i, j = np.searchsorted(leaf, (a, b))
                        parts.append((leaf[i:j] - a, *(x[i:j] for x in rest)))
                    blobs = _dump(term=names.slice(a, b - a)), _dump(**dict(zip("abc", parts[0], strict=True))), _dump(**dict(zip("abc", parts[1], strict=True)))
                    for column, value in zip(rows, (r, *blobs, groups.as_py(), langs.as_py()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:4]), pa.array(rows[4], batch.schema.field(3).type), pa.array(rows[5], batch.schema.field(4).type)], names=["range", "terms", "counts", "spread", "groups", "langs"])

    return run


def _merged(least_docs: int):
    """The tries of a range as one: per language its kept terms and their counters."""

    def run(table: pa.Table) -> pa.Table:
        have, groups, langs = Counters(), {}, {}
        for terms, counts, spread, named, of in zip(*(table.column(c) for c in ("terms", "counts", "spread", "groups", "langs")), strict=True):
            leaf = have.leaves(_load(terms.as_py())[0].to_pylist())
            group = _numbered([(g["lang"], g["source"]) for g in named.as_py()], groups)
            lang = _numbered(of.as_py(), langs)
            for into, blob, number in ((have.counts, counts, group), (have.spread, spread, lang)):
                at, other, n = _numbers(blob.as_py())
                into.append((leaf[at], number[other], n))
        terms, (leaf, group, n), (in_docs, lang, docs) = have.written()
        lang_of = np.array([langs.get(a, -1) for a, _ in groups], np.int64)
        rows = []
        for name, k in langs.items():
            kept = np.sort(in_docs[(lang == k) & (docs >= least_docs)])
            if not len(kept):
                continue
            place = np.full(len(terms), -1, np.int64)
            place[kept] = np.arange(len(kept))
            own = np.flatnonzero((lang_of[group] == k) & (place[leaf] >= 0))
            sources = np.unique(group[own])
            total = np.array([n[own][group[own] == s].sum() for s in sources], np.int64)
            named = list(groups)
            counters = _dump(term=place[leaf[own]], source=np.searchsorted(sources, group[own]), n=n[own])
            rows.append({"lang": name, "range": table.column("range")[0].as_py(), "terms": _dump(term=terms.take(pa.array(kept))), "counts": counters, "sources": [named[s][1] for s in sources], "totals": total.tolist(), "v": len(kept)})
        schema = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("v", pa.int64())])
        return pa.Table.from_pylist(rows, schema)

    return run


def share(count: np.ndarray, total: np.ndarray, digits: int = 3) -> np.ndarray:
    """floor(1000**digits * count / total) by long division: exact for totals below 9 * 10**15."""
    if np.any(total > 9 * 10**15):
        raise OverflowError("more words than shares are exact for")
    out, rest = count // total, count % total
    for _ in range(digits):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out


def _best(value: np.ndarray, most: int) -> np.ndarray:
    """Places of the largest values, the first of equals first."""
    if len(value) > 4 * most:
        bound = np.partition(value, len(value) - most)[len(value) - most]
        at = np.flatnonzero(value >= bound)
    else:
        at = np.arange(len(value))
    return at[np.argsort(-value[at], kind="stable")][:most]


def _compared(pseudo: int, most: int):
    """Sums of differences and best terms of one block of a language's sources over one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, totals = [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64)
                a, b = row["block"] * BLOCK, min(len(names), (row["block"] + 1) * BLOCK)
                sums = np.zeros((b - a, len(names)), np.int64)
                best: list[tuple[int, str, int]] = []
                if row["terms"] is not None:
                    terms = _load(row["terms"])[0].cast(pa.large_string()).to_pylist()
                    leaf, source, n = _numbers(row["counts"])
                    number = {s: i for i, s in enumerate(names)}
                    source = np.array([number[s] for s in row["sources"]], np.int64)[source]
                    size, whole = totals + pseudo * row["v"], totals.sum() + pseudo * row["v"]
                    step = max(1, CELLS // len(names))
                    for t in range(0, len(terms), step):
                        i, j = np.searchsorted(leaf, (t, t + step))
                        c = np.zeros((min(step, len(terms) - t), len(names)), np.int64)
                        c[leaf[i:j] - t, source[i:j]] = n[i:j]
                        p = 1 + share(c + pseudo, size)
                        q = 1 + share(c.sum(1) + pseudo, whole)
                        for s in range(a, b):
                            sums[s - a] += np.abs(p - p[:, [s]]).sum(0)
                            over = np.flatnonzero((c[:, s] > 0) & (p[:, s] > q))
                            value = p[over, s] - q[over]
                            best += [(s, terms[t + over[k]], int(value[k])) for k in _best(value, most)]
                pairs = [(s, o) for s in range(a, b) for o in range(len(names)) if o != s]
                source = [names[s] for s, _ in pairs] + [names[s] for s, _, _ in best]
                part = ["pair"] * len(pairs) + ["term"] * len(best)
                item = [names[o] for _, o in pairs] + [t for _, t, _ in best]
                value = [int(sums[s - a, o]) for s, o in pairs] + [v for _, _, v in best]
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(part), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 30, pseudo: int = 5, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", leaves: int = LEAVES, counters: int = RANGE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every other source is (part pair), and the terms that a source has more than its language (part term).

    least_docs: documents of a language that must have a term; pseudo: added to every
    count; most: ranks of terms; leaves, counters: of a trie and of a merged range.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, F.col(text_col).cast("string").alias("text"))
    with temporary(spark):
        tries = spill(rows.mapInArrow(_counted(leaves), _TRIE + ", groups array<struct<lang:string,source:string>>, langs array<string>"), "tries")
        cuts = _range_cuts(tries, counters)
        parts = tries.mapInArrow(_cut(cuts), "range long, " + _TRIE + ", groups array<struct<lang:string,source:string>>, langs array<string>")
        kept = parts.groupBy("range").applyInArrow(_merged(least_docs), "lang string, range long, terms binary, counts binary, sources array<string>, totals array<long>, v long")
        kept = spill(kept, "kept-terms")
        groups = tries.select(F.explode("groups").alias("g")).select("g.lang", "g.source").distinct()
        totals = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t")).groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("n"))
        langs = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
        langs = langs.join(kept.groupBy("lang").agg(F.sum("v").alias("v")), "lang", "left").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)).cast("long"))))
        joined = langs.join(kept.drop("totals", "v"), ["lang", "range"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / BLOCK))))
        found = joined.mapInArrow(_compared(pseudo, most), "lang string, source string, part string, item string, value long")
        summed = spill(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence", keep=True)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= most))
