"""Near-duplicate documents by a chosen-path set similarity join.

Documents with one set of word shingles (of words with A-Z lower-cased) form a class,
and classes are joined.  A tree starts with all classes; a node chooses some
coordinates of the min-wise signature (the root by its tree, others by a hash of
their path, so all members choose the same ones) and sends a member to one child per
chosen coordinate, named by the token the member has there.  Nodes of at most
``leaf`` members are compared exhaustively; larger ones branch again, each level by
coordinates of its own.  Trees repeat independently, so that a pair of the wanted
similarity parts everywhere only with negligible probability: with 4 trees and 2
coordinates at each root, 0.15**8 at the similarity of 0.85, less above.  A child
that has most of a large node's members is a group of near copies that no coordinate
parts; it is compared in blocks, and so is what is still large at the last level.
In such a node members of the most frequent component need no comparison with each
other, so only the rest is sent to every block.

Pairs that a signature sketch can't rule out are confirmed on the full sets of
64-bit shingle hashes: a set travels once for each node that has pairs of it, not
once per pair.  This happens in two passes.  The first sends every member of a
root's child only to the one before it that it resembles most; the links confirmed
there join most of a group of near copies.  The second does the whole join, but only
where members of different components meet: no link between different components is
lost, groups of copies don't turn into all their pairs, and nodes inside one
component are not looked at again.

Nulls and texts without words have the empty set and are linked with nothing; texts
of fewer words than a shingle have the one shingle of all their words; rows that
repeat an id are documents of their own (and link, if alike), rows without one
come last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import BROADCAST_BYTES, RID, attach, column, identify, numbered, original, spill, temporary, text_chunks
from .graph import components

#: Coordinates of a signature; the sketch has two bits of each, the tokens 32 bits of the first TOKENS.
WIDTH, TOKENS = 512, 32
#: By how many standard deviations fewer agreements than expected a pair may have and still be confirmed (about 1 pair in 10 million has fewer).
SLACK = 5.2
#: Shingles of a member that counts once for the size of a node; longer documents count for more, so that a node's sets fit a worker's memory.
UNIT = 512
#: A child with more than this share of a node's members isn't branched again.
STUCK = 0.75
#: The place of a root, above all sizes.
WHOLE = 1 << 62
_A = np.random.default_rng(41).integers(1, 2**63, WIDTH, dtype=np.uint64) | ts.U(1)
_X = np.random.default_rng(43).integers(1, 2**63, WIDTH, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk (A-Z lower-cased), end to end, and their borders."""
    low = ts.LOWER[buf]
    ws, we, items = ts.words(low, off, ts.SPACED)
    wh = ts.word_hashes(low, ws, we)
    h = ts.grams(wh, size)
    sets = []
    for a, b in zip(items[:-1].tolist(), items[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            sets.append(ts.mix(ts.grams(wh[a:b], b - a) + ts.U(b - a)))
        else:
            sets.append(h[:0])
    return np.concatenate(sets) if sets else h[:0], np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in text_chunks(batches):
            h, at = shingle_sets(buf, off, size)
            n = np.diff(at)
            some = n > 0
            first = at[:-1][some]
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            tokens = np.zeros((len(n), TOKENS), np.uint32)
            pairs = np.zeros((len(n), WIDTH), np.uint8)
            if len(first):
                one[some] = np.add.reduceat(ts.mix(h), first)
                two[some] = np.add.reduceat(ts.mix(h ^ _X[0]), first)
                for j in range(WIDTH):
                    token = ts.mix(np.minimum.reduceat((h ^ _X[j]) * _A[j], first)) >> ts.U(32)
                    pairs[some, j] = token & ts.U(3)
                    if j < TOKENS:
                        tokens[some, j] = token
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(RID)), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([x.tobytes() for x in tokens], pa.binary()), pa.array([x.tobytes() for x in pairs[:, ::4] << 6 | pairs[:, 1::4] << 4 | pairs[:, 2::4] << 2 | pairs[:, 3::4]], pa.binary())],
                names=[RID, "n", "h1", "h2", "tokens", "sketch"],
            )

    return run


def _branch(trees: int, root: int, deeper: int, levels: int, level: int, narrow: bool = False):
    """For mapInArrow over members (at level 0 classes): members of child nodes, ``above`` being their node's size; narrow: without signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.arange(len(batch))
            raw = batch.column(batch.schema.get_field_index("tokens"))
            tokens = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(len(rows), TOKENS)
            who, node = [], []
            if not level:
                for c in range(trees * root):
                    who.append(rows)
                    node.append(_root_nodes(tokens, c, root))
            else:
                # each level has coordinates of its own; which of them, and in what order, comes from the path alone
                path, own = column(batch, "node").view(np.uint64), (TOKENS - trees * root) // levels
                seed = ts.mix(path * ts.ODD[1] + ts.ODD[2])
                for c in range(deeper):
                    at = (trees * root + (level - 1) * own + (seed + ts.U(c) * (ts.U(1) + (seed >> ts.U(40)) % ts.U(own // deeper))) % ts.U(own)).astype(np.int64)
                    who.append(rows)
                    node.append(ts.mix(seed * ts.ODD[3] + at.astype(np.uint64) * ts.ODD[4] + tokens[rows, at] * ts.ODD[5]))
            who, node = np.concatenate(who), pa.array(np.concatenate(node).view(np.int64))
            names = ["n", "label", "size"] if narrow else ["rep", "n", "label", "sketch", "tokens"]
            for a in range(0, len(who), 20_000):
                part = batch.take(pa.array(who[a : a + 20_000]))
                yield pa.RecordBatch.from_arrays([node.slice(a, 20_000), *(part.column(part.schema.get_field_index(c)) for c in names)], names=["node", *names])

    return run


def _root_nodes(tokens: np.ndarray, c: int, root: int) -> np.ndarray:
    """The child that each member goes to from a root's coordinate."""
    path = ts.U((c // root * int(ts.ODD[3]) + c * int(ts.ODD[4])) % 2**64)
    return ts.mix(tokens[:, c] * ts.ODD[5] + path)


def _agreeing(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Coordinates whose two bits agree, of rows of 64-bit words."""
    x = sketch[i] ^ sketch[j]
    x |= x >> ts.U(1)
    return WIDTH - np.bitwise_count(x & ts.U(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def least_agreements(percent: int) -> int:
    """Agreeing coordinates that a pair of so many percent similarity has, but for chances beyond SLACK deviations."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(WIDTH * p - SLACK * np.sqrt(WIDTH * p * (1 - p)))


def _candidates(rep: np.ndarray, n: np.ndarray, label: np.ndarray, sketch: np.ndarray, node: np.ndarray, percent: int, star: bool) -> tuple[np.ndarray, ...]:
    """Pairs (smaller, larger number) worth confirming, with their nodes, of rows sorted by node and rep."""
    total = len(node)
    begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.append(begins, total))
    rows = np.arange(total)
    behind = np.repeat(begins + sizes, sizes) - rows - 1  # members of the node after this one
    wanted = least_agreements(percent)
    best, nearest = np.full(total, wanted - 1), np.full(total, -1)
    left, right, where = [], [], []
    d, alive = 1, rows[behind >= 1]
    while len(alive):
        for a in range(0, len(alive), 1 << 16):
            i = alive[a : a + (1 << 16)]
            j = i + d
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            m = (lo * 100 >= hi * percent) & (label[i] != label[j]) & (rep[i] != rep[j])
            i, j = i[m], j[m]
            if len(i):
                alike = _agreeing(sketch, i, j)
                m = alike >= wanted
                if star:
                    m = alike > best[j]
                    best[j[m]], nearest[j[m]] = alike[m], i[m]
                    continue
                left.append(rep[i[m]])
                right.append(rep[j[m]])
                where.append(node[i[m]])
        d += 1
        alive = alive[behind[alive] >= d]
    if star:
        j = np.flatnonzero(nearest >= 0)
        left, right, where = [rep[nearest[j]]], [rep[j]], [node[j]]
    if not left:
        z = np.zeros(0, np.int64)
        return z, z, z
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b), np.concatenate(where)


def _compare(percent: int, star: bool, level: int, once=None):
    """For mapInArrow over members sorted by node and rep, in nodes of bounded size: members in candidate pairs, with their partners of smaller numbers.

    once: number of the roots' coordinates, branching and the sorted array of the
    roots' large nodes; a pair is then left to the first of the roots' small nodes
    that it shares.
    """

    def elsewhere(t: pa.Table, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether a pair is found in a small node of an earlier coordinate than this node's."""
        coordinates, root, large = once
        reps, at = np.unique(t.column("rep").to_numpy(), return_index=True)
        tokens = np.frombuffer(b"".join(t.column("tokens").take(pa.array(at)).to_pylist()), np.uint32).reshape(-1, TOKENS)
        i, j = np.searchsorted(reps, a), np.searchsorted(reps, b)
        found, earlier = np.zeros(len(a), bool), np.ones(len(a), bool)
        for c in range(coordinates):
            here = _root_nodes(tokens, c, root).view(np.int64)[i]
            if not level:
                earlier &= here != node
            found |= earlier & (tokens[i, c] == tokens[j, c]) & ~np.isin(here, large.value)
        return found

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, WIDTH // 32)
        rep, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
        a, b, node = _candidates(rep, t.column("n").to_numpy(), label, sketch, t.column("node").to_numpy(), percent, star)
        if once is not None and len(a):
            m = ~elsewhere(t, a, b, node)
            a, b, node = a[m], b[m], node[m]
        if not len(a):
            return
        order = np.lexsort((a, b, node))
        a, b, node = a[order], b[order], node[order]
        reps, at = np.unique(rep, return_index=True)
        # a row for each member of a pair: those that are only smaller ones have no partners
        who, where = np.r_[a, b], np.r_[node, node]
        order = np.lexsort((who, where))
        who, where = who[order], where[order]
        new = np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1])]
        who, where = who[new], where[new]
        begins = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (node[1:] != node[:-1])])
        own = {(int(node[x]), int(b[x])): a[x:y].tobytes() for x, y in zip(begins, np.r_[begins[1:], len(a)], strict=True)}
        partners = [own.get(key, b"") for key in zip(where.tolist(), who.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(who), pa.array(label[at[np.searchsorted(reps, who)]]), pa.array(partners, pa.binary())], names=["node", "who", "label", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the members so far of the node that the last batch ended in
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            node = t.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            yield from emit(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield from emit(held)

    return run


def _bounded(df: DataFrame, each: int) -> DataFrame:
    """df, written before, marked for broadcast if its measured size allows."""
    return F.broadcast(df) if df.count() * each <= BROADCAST_BYTES else df


def _weight() -> Column:
    return F.ceil(F.col("n") / UNIT)


def _in_parts(members: DataFrame, leaf: int) -> DataFrame:
    """Members of nodes, larger ones split at random into nodes of about half of leaf."""
    part = F.pmod(F.xxhash64("node", "rep"), F.ceil(F.col("size") * 2 / leaf))
    return members.withColumn("node", F.when(F.col("size") <= leaf, F.col("node")).otherwise(F.xxhash64("node", part)))


def _in_blocks(members: DataFrame, leaf: int) -> DataFrame:
    """Members of large nodes, once for each pair of blocks that theirs belongs to; each pair of blocks is a node.

    Members of the label with most members make blocks of their own, which are paired
    with the others' blocks only.
    """
    by_label = members.groupBy("node", "label").agg(F.sum(_weight()).alias("w"))
    tops = by_label.groupBy("node").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("w")).select("node", F.col("top.label").alias("main"), F.ceil((F.col("w") - F.col("top.w")) * 2 / leaf).cast("int").alias("rests"), F.ceil(F.col("top.w") * 2 / leaf).cast("int").alias("mains"))
    tops = _bounded(spill(tops, "tops"), 40)
    rest = F.col("label") != F.col("main")
    placed = members.join(tops, "node").withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(rest, F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    with_rest = each("rests", lambda j: pair(0, F.least("mine", j), F.greatest("mine", j)))
    sent = F.when(rest, F.concat(with_rest, each("mains", lambda j: pair(1, F.col("mine"), j)))).otherwise(each("rests", lambda j: pair(1, j, F.col("mine"))))
    return placed.withColumn("pair", F.explode(sent)).withColumn("node", F.xxhash64("node", "pair.kind", "pair.x", "pair.y"))


def candidates(classes: DataFrame, star: bool, percent: int, trees: int, root: int, deeper: int, levels: int, leaf: int) -> DataFrame:
    """(node, who, label, partners): members of pairs to confirm, of classes (rep, n, label, tokens, sketch) with different labels; partners have smaller numbers."""
    found = None
    above = classes.withColumn("size", F.lit(WHOLE))
    once = None
    for level in range(levels + 1):
        grown = (trees, root, deeper, levels, level)
        # which nodes have members of different labels, and how many; counted where they are before they travel
        narrow = above.mapInArrow(_branch(*grown, narrow=True), "node long, n long, label long, size long")
        sizes = narrow.groupBy("node").agg(F.sum(_weight()).alias("size"), F.max("size").alias("above"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sizes = spill(sizes.filter("lo <> hi").select("node", "size", "above"), "node-sizes")
        members = above.mapInArrow(_branch(*grown), "node long, rep long, n long, label long, sketch binary, tokens binary").join(_bounded(sizes, 48), "node")
        large = sizes.filter(F.col("size") > leaf)
        some_large = bool(large.take(1))
        small = members.filter(F.col("size") <= leaf)
        again = None
        if some_large and star:
            small = _in_parts(members, leaf)
        elif some_large:
            members = spill(members, "members")
            stuck = (F.col("size") > leaf) & (F.lit(level == levels) | (F.col("size") > F.col("above") * STUCK))
            small = members.filter(F.col("size") <= leaf).unionByName(_in_blocks(members.filter(stuck), leaf).select(*members.columns))
            again = members.filter((F.col("size") > leaf) & ~stuck).drop("above")
        if level == 0 and large.count() * 8 <= BROADCAST_BYTES:
            names = np.sort(np.array([r[0] for r in large.select("node").toLocalIterator()], np.int64))
            once = (trees * root, root, classes.sparkSession.sparkContext.broadcast(names))
        columns = ["node", "rep", "n", "label", "sketch"] + ["tokens"] * (once is not None)
        ordered = small.select(*columns).repartition("node").sortWithinPartitions("node", "rep")
        pairs = spill(ordered.mapInArrow(_compare(percent, star, level, once), "node long, who long, label long, partners binary"), "node-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if again is None or not again.take(1):
            break
        above = again
    return found


def _sets(size: int):
    """For mapInArrow over (RID, text, payload): the shingle set of each document for each node where it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in text_chunks(batches):
            h, at = shingle_sets(buf, off, size)
            rid = column(batch, RID).tolist()
            rows: list[tuple] = []
            held = 0
            for i, sends in enumerate(batch.column(batch.schema.get_field_index("payload")).to_pylist()):
                data = h[at[i] : at[i + 1]].tobytes()
                for s in sends:
                    rows.append((s["node"], rid[i], s["label"], s["partners"], data))
                    held += len(data) + len(s["partners"])
                    if held > 4 << 20:
                        yield _set_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _set_batch(rows)

    return run


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"node": pa.int64(), "who": pa.int64(), "label": pa.int64(), "partners": pa.binary(), "shingles": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _confirm(percent: int):
    """For mapInArrow over sets sorted by (node, who): links; partners have smaller numbers, so their sets come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: int | None = None
        sets: dict[int, np.ndarray] = {}
        joined: dict[int, int] = {}  # union-find over the labels of the node
        labels: dict[int, int] = {}

        def top(x: int) -> int:
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        for batch in batches:
            left, right = [], []
            node, who, label = (column(batch, c).tolist() for c in ("node", "who", "label"))
            partners, data = (batch.column(batch.schema.get_field_index(c)) for c in ("partners", "shingles"))
            for i in range(len(batch)):
                if node[i] != here:
                    here, sets, joined, labels = node[i], {}, {}, {}
                own = np.frombuffer(data[i].as_py(), np.uint64)
                sets[who[i]], labels[who[i]] = own, label[i]
                for a in np.frombuffer(partners[i].as_py(), np.int64).tolist():
                    x, y = top(labels[a]), top(label[i])
                    if x == y:
                        continue
                    other = sets[a]
                    at = np.searchsorted(other, own)
                    at[at == len(other)] = 0
                    both = int(np.count_nonzero(other[at] == own))
                    if 100 * both >= percent * (len(other) + len(own) - both):
                        left.append(a)
                        right.append(who[i])
                        joined[y] = x
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirmed(docs: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the members found by candidates(), by their full shingle sets; in a node only links that join what no other there has joined."""
    side = spill(found.groupBy(F.col("who").alias(RID)).agg(F.collect_list(F.struct("node", "label", "partners")).alias("payload")), "sends")
    bytes_of = F.aggregate("payload", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x["partners"]) + 48)
    texts = attach(docs.select(RID, "text"), side, how="inner", each=bytes_of)
    sets = texts.mapInArrow(_sets(size), "node long, who long, label long, partners binary, shingles binary")
    ordered = sets.repartition("node").sortWithinPartitions("node", "who")
    return ordered.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = 4, root: int = 2, deeper: int = 3, levels: int = 4, leaf: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(RID, doc_id, n_shingles, component, component_id, kept): documents are linked from ``percent`` similarity on.

    component_id: the smallest doc_id reachable over links; kept: the one document of
    each component that stays.
    """
    docs = identify(docs, id_col, text_col)
    with temporary(docs.sparkSession):
        out = _components_of(docs, shingle, percent, (trees, root, deeper, levels, leaf))
    ids = docs.select(RID, "doc_id")
    out = out.join(ids, RID)
    names = ids.select(F.col(RID).alias("component"), F.col("doc_id").alias("component_id"))
    same = out.filter(F.col("component") == F.col(RID)).withColumn("component_id", F.col("doc_id"))
    other = out.filter(F.col("component") != F.col(RID)).join(names, "component")
    columns = [RID, "doc_id", "n_shingles", "component", "component_id"]
    return same.select(*columns).unionByName(other.select(*columns)).withColumn("kept", F.col("component") == F.col(RID))


def _components_of(docs: DataFrame, shingle: int, percent: int, tree: tuple) -> DataFrame:
    """(RID, n_shingles, component): component is the smallest row number reachable."""
    signed = spill(docs.select(RID, "text").mapInArrow(_signatures(shingle), f"{RID} long, n long, h1 long, h2 long, tokens binary, sketch binary"), "signatures")
    grouped = signed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min(RID).alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    grouped = spill(grouped, "classes")
    classes = grouped.select("rep", "n", F.col("rep").alias("label"), "tokens", "sketch")
    first = spill(confirmed(docs, candidates(classes, True, percent, *tree), shingle, percent), "near-links")
    joined = spill(components(first), "labels")
    labelled = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("component", "label").alias("label"), "tokens", "sketch")
    labelled = spill(labelled, "labelled")
    second = spill(confirmed(docs, candidates(labelled, False, percent, *tree), shingle, percent), "links")
    whole = spill(components(first.unionByName(second)), "components")
    reps = grouped.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    # only documents of classes or components with others need a look-up
    shared = reps.filter("copies > 1 or component <> rep").select("n", "h1", "h2", "component")
    out = signed.join(shared, ["n", "h1", "h2"], "left").select(RID, F.col("n").alias("n_shingles"), F.coalesce("component", RID).alias("component"))
    return spill(out, "near-rows", keep=True)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component; all columns stay."""
    rows = numbered(docs, id_col, text_col)
    with temporary(docs.sparkSession):
        gone = spill(near_duplicates(rows, shingle, percent, id_col=id_col, text_col=text_col).filter("not kept").select(RID, F.lit(b"").alias("payload")), "near-gone", keep=True)
    return original(attach(rows, gone, how="left_anti"), docs)
