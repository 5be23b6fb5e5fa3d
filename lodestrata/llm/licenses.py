"""License scan with a positional index of rare words.

Templates are passages and whole texts of licences, each with a key phrase that must
stand in it.  A first pass counts in how many documents each template word occurs
(over all documents); that gives the words' IDF.  The index then has postings
(template, position) of each template's highest-IDF words: so many that a text with
the share ``least`` of the template's IDF weight must have two of them.

The scan looks up these words in every document.  An occurrence at p of a word that
a template has at q proposes that the template begins at p - q; the proposals are
intersected by that relative position, and only where two words of a template agree
(within ``shift`` words) is it looked at further: its key phrase must stand there word
for word, and then all its words vote.  The template is found if their share of its
IDF weight reaches ``least``.  Nothing is cut off per document: other templates in
the same document take nothing away from one.

The base labels are templates of one key phrase each; all their places count.

Words are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII.
Nulls count as empty; rows are scanned each for itself, whether ids repeat or are
missing; an empty table gives an empty result; extra columns are ignored.  Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import text_chunks


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


#: Fixed values of the contract: phrases and their labels.
BASE = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
)
#: Passages of public licence texts, as words.
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("cc", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc", "licensed under cc by", "licensed under cc by"),
    Template("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", "all rights reserved"),
)
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_DISCLAIMER = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
#: Whole public licence texts and notices, as words.
TEXTS = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        + _WARRANTY
        + " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "shall be included in all copies or substantial portions of the software",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        + _DISCLAIMER
        + " in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "this permission notice appear in all copies",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "governing permissions and limitations under the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        "you should have received a copy of the gnu general public license",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "altered source versions must be plainly marked as such",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "any and all copyright interest in the software to the public domain",
    ),
)


def _hashes(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode("utf-8") for w in words]
    off = np.r_[0, np.cumsum([len(r) for r in raw])]
    return ts.word_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])


class Index:
    """Word numbers, templates and key phrases as word numbers, and postings of rare words once the words' IDF is known."""

    def __init__(self, templates: Sequence[Template]) -> None:
        self.templates = tuple(templates)
        vocabulary = sorted({w for t in templates for w in t.text.split()})
        h = _hashes(vocabulary)
        order = np.argsort(h)
        self.hashes, self.words = h[order], [vocabulary[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.texts = [np.array([number[w] for w in t.text.split()]) for t in templates]
        self.keys = [np.array([number[w] for w in t.key.split()]) for t in templates]
        self.key_at = [next(i for i in range(len(t)) if (t[i : i + len(k)] == k).all()) for t, k in zip(self.texts, self.keys, strict=True)]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes & ts.U(0xFFFF)).astype(np.int64)] = True

    def postings(self, idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Border of each word's postings, their templates and positions, and how many positions of a template must agree.

        Of each template the positions with the highest IDF, as few as leave no text
        with the share ``least`` of its weight without two of them (one, where the
        template is too short for that).
        """
        rows, agree = [], []
        for t, (text, template) in enumerate(zip(self.texts, self.templates, strict=True)):
            order = np.argsort(-idf[text], kind="stable")
            weight = idf[text][order]
            spare = np.cumsum(weight) - weight[0]  # what the first positions weigh without the heaviest one
            enough = np.flatnonzero(spare > (1 - least) * weight.sum() + 1e-9)
            two = len(enough) > 0 and not template.base
            n = 1 if template.base else int(enough[0]) + 1 if two else len(text)
            agree.append(2 if two else 1)
            rows += [(int(text[q]), t, q) for q in order[:n].tolist()]
        word, t, q = (np.array(c) for c in zip(*sorted(rows), strict=True))
        return np.searchsorted(word, np.arange(len(self.words) + 1)), t, q, np.array(agree)

    def find(self, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words among word hashes, and their numbers."""
        at = np.flatnonzero(self.maybe[(wh & ts.U(0xFFFF)).astype(np.int64)])
        v = np.minimum(np.searchsorted(self.hashes, wh[at]), len(self.hashes) - 1)
        hit = self.hashes[v] == wh[at]
        return at[hit], v[hit]

    def phrase_at(self, wh: np.ndarray, start: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the words stand at each start, inside low..high."""
        ok = (start >= low) & (start + len(words) <= high)
        for i, w in enumerate(words):
            ok[ok] = wh[start[ok] + i] == self.hashes[w]
        return ok


def _document_frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.words), np.int64), 0
        for batch, buf, off in text_chunks(batches):
            low = ts.LOWER[buf]
            ws, we, items = ts.words(low, off, ts.ALNUM)
            at, v = index.find(ts.word_hashes(low, ws, we))
            doc = np.searchsorted(items, at, side="right") - 1
            df += np.bincount(np.unique(doc * len(df) + v) % len(df), minlength=len(df))
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.r_[n, df])], names=["word", "n"])

    return run


def _scan(index: Index, idf: np.ndarray, least: float, shift: int):
    border, of_template, position, agree = index.postings(idf, least)
    weight = [idf[t].sum() for t in index.texts]
    slack = np.array([0 if t.base else shift for t in index.templates])

    def proposed(at: np.ndarray, v: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, document, begin) that enough rare words of a template agree on, sorted and distinct."""
        n = border[v + 1] - border[v]
        row = np.repeat(np.arange(len(v)), n)
        which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + border[v][row]
        t, q, d = of_template[which], position[which], doc[row]
        begin = at[row] - q
        order = np.lexsort((q, begin, d, t))
        t, q, d, begin = t[order], q[order], d[order], begin[order]
        good = agree[t] == 1
        near, k = np.arange(len(t)), 1
        while len(near := near[near + k < len(t)]):
            near = near[(t[near] == t[near + k]) & (d[near] == d[near + k]) & (begin[near + k] - begin[near] <= 2 * slack[t[near]])]
            two = near[q[near] != q[near + k]]
            good[two] = good[two + k] = True
            k += 1
        t, d, begin = t[good], d[good], begin[good]
        moves = np.arange(-shift, shift + 1)
        t, d, begin, move = np.repeat(t, len(moves)), np.repeat(d, len(moves)), np.repeat(begin, len(moves)), np.tile(moves, len(t))
        m = np.abs(move) <= slack[t]
        t, d, begin = t[m], d[m], (begin + move)[m]
        order = np.lexsort((begin, d, t))
        t, d, begin = t[order], d[order], begin[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]) | (begin[1:] != begin[:-1])] if len(t) else np.zeros(0, bool)
        return t[new], d[new], begin[new]

    def places(wh, items, t, d, begin):
        """(place of the key phrase, document, share of weight) of the proposals of template t whose key phrase stands there and whose share is enough."""
        start = begin + index.key_at[t]
        ok = index.phrase_at(wh, start, index.keys[t], items[d], items[d + 1])
        start, d, begin = start[ok], d[ok], begin[ok]
        if index.templates[t].base or not len(start):
            return start, d, np.ones(len(start))
        low, high = items[d], items[d + 1]
        best = np.zeros(len(start))
        for q, w in enumerate(index.texts[t]):
            found = np.zeros(len(start), bool)
            for p in range(q - shift, q + shift + 1):
                inside = np.flatnonzero((begin + p >= low) & (begin + p < high))
                found[inside] |= wh[begin[inside] + p] == index.hashes[w]
            best += found * idf[w]
        best /= weight[t]
        good = best >= least
        return start[good], d[good], best[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in text_chunks(batches):
            low = ts.LOWER[buf]
            ws, we, items = ts.words(low, off, ts.ALNUM)
            wh = ts.word_hashes(low, ws, we)
            at, v = index.find(wh)
            doc = np.searchsorted(items, at, side="right") - 1
            n = len(batch)
            n_base, first, last, score = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), np.zeros(n)
            base: list[set[str]] = [set() for _ in range(n)]
            labels: list[set[str]] = [set() for _ in range(n)]
            of, who, begin = proposed(at, v, doc)
            cut = np.searchsorted(of, np.arange(len(index.templates) + 1))
            for t, template in enumerate(index.templates):
                mine = slice(cut[t], cut[t + 1])
                start, d, share = places(wh, items, t, who[mine], begin[mine])
                np.maximum.at(score, d, share * (0.5 if template.base else 1.0))
                for i in np.unique(d).tolist():
                    labels[i].add(template.label)
                    if template.base:
                        base[i].add(template.label)
                if template.base and len(d):
                    own = start - items[d]
                    n_base += np.bincount(d, minlength=n)
                    np.maximum.at(last, d, own)
                    low_at = np.full(n, np.iinfo(np.int64).max)
                    np.minimum.at(low_at, d, own)
                    some = np.unique(d)
                    first[some] = np.where(first[some] < 0, low_at[some], np.minimum(first[some], low_at[some]))
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(items)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(np.round(np.minimum(score, 1.0), 6)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + PASSAGES + TEXTS, least: float = 0.5, shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    score: the best share of a template's IDF weight found with its key phrase; 0.5
    where only a base phrase stands.
    """
    index = Index(templates)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = dict(texts.mapInArrow(_document_frequencies(index), "word long, n long").groupBy("word").agg(F.sum("n")).collect())  # a row per template word
    n = counts.get(-1, 0) or 0
    idf = np.array([np.log((n + 1) / ((counts.get(i) or 0) + 1)) + 1 for i in range(len(index.words))])
    return texts.mapInArrow(_scan(index, idf, least, shift), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
