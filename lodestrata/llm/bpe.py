"""Byte-pair encoding with word ends by a segment tree, and its decoding.

A piece of text is a row of byte symbols, the last one marked as a word's end.  The
leaves of a segment tree hold the rank of each symbol with its next living
neighbour; every inner node holds the least rank below it.  The root is the lowest
rank of the whole piece, and walking down to the left wherever the left child has it
finds the *leftmost* pair of that rank.  A merge changes three leaves, so a piece of
n bytes takes O(n log n) steps, however long it is: a text without a single break is
no special case.  It ends when the root holds no rank.

Normalisation and splitting follow the tokenizer file.  Texts of ordinary characters
take a quick way to the same pieces; all others are normalised and split by the
file's own library.  Strings of added tokens in a text become those tokens, as the
library's defaults have it.  Pieces that come again are looked up in a memo of
bounded size, one per worker process.

Nulls count as empty text (no tokens); rows are encoded each for itself, whether ids
repeat or are missing; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .packing import _byte_symbols

#: How tokenizers of this family normalise and split text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split for lower-cased ASCII.
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Characters that all libraries class and lower-case alike, none of which composes with another.
_RARE = re.compile("[^\\n\\r\\t\\x20-\\x7e¡-¬®-įı-ɏ‐-‧€]")
#: Entries of a memo, and bytes of a piece that is kept there.
MEMO, MEMO_BYTES = 400_000, 64
_NONE = 1 << 60


class LeastRanks:
    """A segment tree over the ranks of adjacent pairs; the root is the least, its leftmost place is found by walking down."""

    def __init__(self, ranks: list[int]) -> None:
        self.width = width = 1 << max(0, len(ranks) - 1).bit_length()
        self.tree = tree = [_NONE] * width + ranks + [_NONE] * (width - len(ranks))
        for at in range(width - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a <= b else b

    def leftmost(self) -> int:
        tree, at, least = self.tree, 1, self.tree[1]
        while at < self.width:
            at *= 2
            if tree[at] != least:
                at += 1
        return at - self.width

    def put(self, place: int, rank: int) -> None:
        tree, at = self.tree, place + self.width
        tree[at] = rank
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a <= b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1


class Codec:
    """Ids of texts and texts of ids for a BPE file whose words end in a suffix."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("a BPE file without prefixes, fallback, dropout, decoder and post-processor is needed")
        end = model.get("end_of_word_suffix") or ""
        symbols = _byte_symbols()
        self.byte_of = symbols
        self.inner, self.last = [0] * 256, [0] * 256
        for c, b in symbols.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        #: (left id, right id) -> (rank, id of both); ranks follow the file's order.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        added = self.full.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens must be plain strings")
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        steps = spec["pre_tokenizer"].get("pretokenizers", [{}])
        self.quick = spec["normalizer"] == NORMALIZER and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") is True
        self.split = regex.compile(SPLIT)
        self.texts: dict[str, list[int]] = {}
        names = {i: t for t, i in vocab.items()} | {i: t.content for i, t in added.items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(piece)
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        merges, none = self.merges, (_NONE, 0)
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        tree = LeastRanks([p[0] for p in pairs])
        if n == 1 or tree.tree[1] == _NONE:
            return ids
        made = [p[1] for p in pairs]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while tree.tree[1] != _NONE:
            at = tree.leftmost()
            gone = after[at]
            ids[at] = made[at]
            alive[gone] = False
            follows = after[at] = after[gone]
            if gone < n - 1:
                tree.put(gone, _NONE)
            if follows < n:
                before[follows] = at
                rank, made[at] = merges.get((ids[at], ids[follows]), none)
            else:
                rank = _NONE
            tree.put(at, rank)
            prior = before[at]
            if prior >= 0:
                rank, made[prior] = merges.get((ids[prior], ids[at]), none)
                tree.put(prior, rank)
        return [i for i, here in zip(ids, alive, strict=True) if here]

    def _piece(self, piece: str, raw: bytes) -> list[int]:
        ids = self.merged(raw)
        if len(raw) <= MEMO_BYTES:
            if len(self.texts) >= MEMO:
                self.texts.clear()
            self.texts[piece] = ids
        return ids

    def _ordinary(self, text: str, out: list[int]) -> None:
        """Appends the ids of a text without added tokens."""
        memo = self.texts
        if self.quick and not _RARE.search(text):
            pieces = _ASCII_SPLIT.findall(text.lower()) if text.isascii() else self.split.findall(text.lower())
            for p in pieces:
                ids = memo.get(p)
                out += self._piece(p, p.encode()) if ids is None else ids
            return
        normal = self.full.normalizer.normalize_str(text) if self.full.normalizer else text
        for shown, _ in self.full.pre_tokenizer.pre_tokenize_str(normal):
            raw = bytes(map(self.byte_of.__getitem__, shown))
            out += self.merged(raw) if raw else []

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.at_special is None or not self.at_special.search(text):
            if text:
                self._ordinary(text, out)
            return out
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self._ordinary(part, out)
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list, special ones too, joined by blanks; ids that the file doesn't have are left out."""
        flat = ids.flatten().cast(pa.int64())
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names)))
        names = self.names.take(pc.if_else(known, flat, None))
        off = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]
        if names.null_count:
            there = names.is_valid().to_numpy(zero_copy_only=False)
            off, names = np.r_[0, np.cumsum(there)][off], names.drop_null()
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), names), pa.scalar(" ", pa.large_string())).cast(pa.string())


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    kept = sys.__dict__.setdefault("_ls_codecs", {})
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            flat, off = [], [0]
            for text in batch.column(1):
                flat.append(np.array(encode(text.as_py() or ""), np.int32))
                off.append(off[-1] + len(flat[-1]))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row; tokenizer: path of the file, the same on all executors."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(tokenizer), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode(batch.column(1))], names=["doc_id", "ids", "text"])

    return run


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids); null ids give an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(_decoded(tokenizer), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decode()'s rows."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
