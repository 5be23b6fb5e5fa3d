"""Packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they are read; only their pieces' lengths and
checksums travel.  A document longer than a sequence fills whole sequences first;
what is left of it is packed first-fit decreasing, with a tournament tree over the
bins' free space, in randomised groups of bounded size: pieces are dealt to
partitions by a hash of row number and place, ordered by it there, and taken ``group`` at a time, so a
task's memory does not depend on how many documents there are or share a key.

Ids are those of the file's own library with its defaults, so a string of an added
token in a text becomes that token; ordinary text takes a quicker way to the same ids.

Nulls count as empty text (a document of one closing id); rows that repeat an id
or have none are packed like any others, each for itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, identify

#: Fixed value: how byte-level BPE of this family splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts of other characters go to the reference tokenizer: libraries may class rare ones differently.
_PLAIN = re.compile("[^\\n\\r\\t\\x20-\\x7e¡-¬®-ɏ‐-‧€]")

#: What a piece is known by; the row number is the documents' own.
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file; quick for ordinary text, by the file's own library for the rest."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        # strings of added tokens in a text are those tokens, so such texts go to the file's own library
        added = [re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        ids = [vocab[m] for m in merged]
        made = set(ids)
        self.quick = None
        if all(a < b for a, b in zip(ids, ids[1:], strict=False)):  # ids follow the merges' order, as ranks do
            ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if all(c in symbols for c in t) and (len(t) == 1 or i in made)}
            self.quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.quick is not None and not _PLAIN.search(text) and not (self.added and self.added.search(text)):
            return self.quick.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    kept = sys.__dict__.setdefault("_ls_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _tokenise(path: str, length: int, close: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(close)
                view = memoryview(ids)
                for a in range(0, len(ids), length):
                    part = view[a : a + length]
                    row = [rid, doc, a, len(part), zlib.crc32(part), len(ids)]
                    for c, v in zip(out, row + [part.tolist()] * with_ids, strict=True):
                        c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:6]] + [pa.array(c, pa.list_(pa.int32())) for c in out[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[RID, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 + with_ids])

    return run


class Tournament:
    """Free space of bins in a tree of maxima; finds the first bin with room in a few steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free space it had) of the first bin with room for size."""
        tree, at = self.tree, 1
        while at < self.width:
            at *= 2
            if tree[at] < size:
                at += 1
        room = tree[at]
        tree[at] = room - size
        found = at - self.width
        at //= 2
        while at:
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
        return found, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    tree = Tournament(len(sizes), capacity)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        where[i], room = tree.place(size)
        offset[i] = capacity - room
    return where, offset


def _pack(capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 40, 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            where, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
            out = table.append_column("sequence_id", pa.array(base + number + where)).append_column("offset", pa.array(offset))
            number += int(where.max()) + 1
            yield from out.combine_chunks().to_batches()

        have, rows = [], 0
        for batch in batches:
            batch = batch.drop_columns(["deal", RID])
            while rows + len(batch) >= group:
                cut = group - rows
                have.append(batch.slice(0, cut))
                yield from packed(pa.Table.from_batches(have))
                batch, have, rows = batch.slice(cut), [], 0
            if len(batch):
                have.append(batch)
                rows += len(batch)
        if have:
            yield from packed(pa.Table.from_batches(have))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 1, group: int = 16384, seed: int = 7, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    tokenizer: path of a tokenizer file, the same on all executors; close: the id
    after each document; group: pieces that are packed together.
    """
    schema = PIECES + ", ids array<int>" * with_ids
    pieces = identify(docs, id_col, text_col).mapInArrow(_tokenise(tokenizer, capacity, close, with_ids), f"{RID} long, " + schema)
    # the row number tells equal rows apart, so that they too are dealt to all partitions
    dealt = pieces.withColumn("deal", F.xxhash64(RID, "start", "ids_crc32", F.lit(seed))).repartition("deal")
    ordered = dealt.sortWithinPartitions("deal", RID, "start")
    return ordered.mapInArrow(_pack(capacity, group), schema + ", sequence_id long, offset long")


def sequences(pieces: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces with ids, padded to capacity unless their number is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    full = F.expr("n_tokens & (n_tokens - 1)") == 0
    padded = F.when(full, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), (F.lit(capacity) - F.col("n_tokens")).cast("int"))))
    return whole.select("sequence_id", "n_tokens", padded.alias("ids"))
