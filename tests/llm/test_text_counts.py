"""Encoding, source divergence and phrases against the library and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bpe, divergence, phrases

PATH = "/opt/tokenizers/word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, rank string, phrase int"
WORDS = "alpha beta gamma delta Épsilon zeta ETA theta".split()


def some_rows():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "-1 "]) for _ in range(rng.randint(0, 60)))
        rows.append((i % 140, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), "r", 1))
    rows += [(None, None, "en", "empty", "r", 1), (3, "", "xx", "a", "r", 1), (4, None, "xx", "b", "r", 1), (5, "alpha beta " * 4000, "en", "a", "r", 1), (6, "alpha\x00beta \x7f   gämma", "fr", "ß", "r", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_encoding_equals_the_library(spark, docs, library):
    got = bpe.digest(bpe.decode(bpe.encode(docs, PATH), PATH))
    want = []
    for doc, text, *_ in some_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digest(bpe.decode(bpe.encode(none, PATH), PATH)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aabcdeé İıſΣς'stdm10.,!?\t\n\x0b\x1c\x85 "), st.characters(exclude_categories=["Cs"])), max_size=40), st.sampled_from(["", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>"]))
def test_any_text_encodes_as_in_the_library(text, special):
    from tokenizers import Tokenizer

    full = test_any_text_encodes_as_in_the_library.__dict__.setdefault("full", Tokenizer.from_file(PATH))
    whole = text[: len(text) // 2] + special + text[len(text) // 2 :]
    ids = full.encode(whole, add_special_tokens=False).ids
    assert bpe.codec(PATH).encode(whole) == ids
    assert bpe.codec(PATH).decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [full.decode(ids, skip_special_tokens=False)]


def test_a_long_piece_and_ids_of_no_token(library):
    for piece in ("a" * 50_000, "".join(random.Random(1).choices("abcdefgh", k=50_000))):
        assert bpe.codec(PATH).encode(piece) == library.encode(piece, add_special_tokens=False).ids
    odd = [[], None, [1, 999_999, -3, 2], [49407]]
    assert bpe.codec(PATH).decode(pa.array(odd, pa.list_(pa.int32()))).to_pylist() == ["", "", library.decode([1, 2]), "<|endoftext|>"]


def test_least_ranks():
    rng = random.Random(2)
    for size in (0, 1, 2, 5, 16, 33):
        values = [rng.randint(0, 4) for _ in range(size)]
        tree = bpe.LeastRanks(list(values))
        for _ in range(40):
            if values:
                at = rng.randrange(size)
                values[at] = rng.choice([0, 1, 2, 3, bpe._NONE])
                tree.put(at, values[at])
                assert tree.tree[1] == min(values)
                if min(values) < bpe._NONE:
                    assert tree.leftmost() == values.index(min(values))


def diverging(rows, least, most):
    terms = [(lang or "", source or "", [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]) for _, text, lang, source, *_ in rows]
    docs, counts = defaultdict(int), defaultdict(int)
    for lang, source, words in terms:
        for w in set(words):
            docs[lang, w] += 1
        for w in words:
            counts[lang, source, w] += 1
    out, utf8 = [], lambda x: x[1].encode()
    for lang in {t[0] for t in terms}:
        kept = [w for (a, w), n in docs.items() if a == lang and n >= least]
        sources = sorted({t[1] for t in terms if t[0] == lang})
        total = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (counts[lang, s, w] + 5) // (total[s] + 5 * len(kept)) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(counts[lang, s, w] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s, w] - p[o, w]) for w in kept), o) for o in sources if o != s]
            best = [(p[s, w] - q[w], w) for w in kept if counts[lang, s, w] > 0 and p[s, w] > q[w]]
            for part, rows_, n in (("pair", pairs, None), ("term", best, most)):
                ordered = sorted(sorted(rows_, key=utf8), key=lambda x: -x[0])[:n]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ordered, 1)]
    return out


@pytest.mark.parametrize("leaves,counters", [(600_000, 400_000), (4, 3)])
def test_source_divergence(spark, docs, leaves, counters):
    got = divergence.audit(docs, least_docs=20, most=3, leaves=leaves, counters=counters).collect()
    assert Counter(map(tuple, got)) == Counter(diverging(some_rows(), 20, 3))
    assert {r["value"] for r in got if r["lang"] == "xx"} == {0}
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tries_walk_in_byte_order():
    rng = random.Random(3)
    terms = {"".join(rng.choices("abé中🎉", k=rng.randint(1, 6))).encode() for _ in range(400)} | {b"a", b"ab", b"abc"}
    trie = divergence.RadixTrie()
    numbers = {t: trie.put(t) for t in rng.sample(sorted(terms), len(terms))}
    assert {t: trie.put(t) for t in terms} == numbers and trie.leaves == len(terms)
    assert list(trie.walk()) == [(t, numbers[t]) for t in sorted(terms)]


def test_shares_are_exact():
    count = np.array([0, 1, 7, 10**14 + 3, 8 * 10**15], np.int64)
    total = np.array([3, 10**9 + 7, 7, 3 * 10**14 + 1, 9 * 10**15], np.int64)
    assert divergence.share(count, total).tolist() == [10**9 * a // b for a, b in zip(count.tolist(), total.tolist(), strict=True)]
    with pytest.raises(OverflowError):
        divergence.share(count, total * 2)


def mined(rows, least, inside, most):
    out, counts, words_of = [], defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        candidates = {k: n for k, n in f.items() if len(k) > 1 and n >= least}
        rows_ = []
        for k, a in candidates.items():
            if any(len(o) > len(k) and 100 * n >= inside * a and any(o[i : i + len(k)] == k for i in range(len(o))) for o, n in candidates.items()):
                continue
            score, cut = min((10**6 * a * a // (f[k[:c]] * f[k[c:]]), c) for c in range(1, len(k)))
            rows_.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        out += [(lang, r, p.decode(), -a, x, y, words_of[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:most], 1)]
    return out


@pytest.mark.parametrize("shard,most", [(1_500_000, 2000), (50, 7)])
def test_phrases(spark, docs, shard, most):
    got = phrases.mine(docs, most=most, shard=shard).collect()
    assert Counter(map(tuple, got)) == Counter(mined(some_rows(), 10, 50, most))
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", "x", 1, big), ("en", "y", 1, big + 1), ("en", "x y", 2, big - 1)], "lang string, phrase string, size int, n long")
    assert [tuple(r) for r in phrases.scored(counts).collect()] == [("en", "x y", big - 1, big, big + 1, 10**6 * (big - 1) ** 2 // (big * (big + 1)))]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_states_have_equal_end_places(seed):
    rng = random.Random(seed)
    words = np.array([rng.randint(0, 3 + seed) for _ in range(300)])
    fresh = np.array([i == 0 or rng.random() < 0.1 for i in range(300)])
    kind = np.cumsum(fresh) % 2
    places = defaultdict(set)
    for i in range(300):
        for k in (1, 2, 3):
            if i - k + 1 >= 0 and not fresh[i - k + 2 : i + 1].any():
                places[kind[i], tuple(words[i - k + 1 : i + 1])].add(i)
    machine = phrases.SuffixAutomaton(words, fresh, kind, 3)
    got = {}
    for k, end, n in machine.phrases():
        for e, m in zip(end.tolist(), n.tolist(), strict=True):
            key = kind[e], tuple(words[e - k + 1 : e + 1])
            assert key not in got
            got[key] = m
    assert got == {k: len(v) for k, v in places.items()}
    assert sum(len(heads) for heads, _ in machine.states()) == len({(k[0], frozenset(v)) for k, v in places.items()})
