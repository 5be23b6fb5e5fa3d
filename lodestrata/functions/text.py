"""Text expressions: trigrams, cleaning, numbers, metrics, token windows."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What stands between the words of a text.
NO_WORD = r"[^\p{L}\p{N}]+"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")
    # words repeat; their trigrams need to be cut only once
    grams = F.transform(F.array_distinct(words), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 2), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two arrays of distinct trigrams; 0.0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def normalise_numbers(text: Column) -> Column:
    """Currency signs and commas go, percent signs move to their numbers."""
    out = F.regexp_replace(text, r"\$\s*", "")
    out = F.regexp_replace(out, ",", "")
    return F.regexp_replace(out, r"(\d)\s+%", "$1%")


#: Scale words and their factors.
SCALES = {"billion": 1e9, "million": 1e6, "thousand": 1e3}
#: Metric names and the patterns of their first mention (number, then scale word where one may follow).
METRICS = {
    "revenue": r"(?i)(?:revenue|net\s+revenue|total\s+revenue)[^\d]*([\d,]+(?:\.\d+)?)\s*(billion|million|thousand)?",
    "net_income": r"(?i)net\s+(?:income|earnings|loss)[^\d]*([\d,]+(?:\.\d+)?)\s*(billion|million|thousand)?",
    "eps": r"(?i)(?:earnings\s+per\s+(?:diluted\s+)?share|eps)[^\d]*\$?([\d]+(?:\.\d+)?)",
    "margin_pct": r"(?i)(?:operating|gross|net)\s+margin[^\d]*([\d]+(?:\.\d+)?)\s*%",
}


def metric(text: Column, name: str) -> Column:
    """The first mention of a metric, scaled; null if there is none or its number can't be read."""
    pattern = METRICS[name]
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    if "billion" not in pattern:
        return number
    word = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(1.0)
    for scale, by in SCALES.items():
        factor = F.when(word == scale, F.lit(by)).otherwise(factor)
    return number * factor


def extract_metrics(text: Column) -> Column:
    """map of metric name to value, only of those that are there."""
    pairs = [x for name in METRICS for x in (F.lit(name), metric(text, name))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which has no builtin."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


#: Fixed value: all that ends a line of text.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: What is noise in a text, in order of removal; each becomes one blank.
NOISE = (
    r"(?i)\b(https?|ftp)://\S+",
    r"\S+@\S+\.\S+",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]",
    r"\n{4,}",
)


def clean(text: Column, normal: bool = True) -> Column:
    """Composed text without noise, lines with single blanks and stripped, at most two blank lines in a row."""
    out = nfkc(text) if normal else text
    for pattern in NOISE:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, LINE_ENDS, "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    out = F.regexp_replace(out, r"\n{4,}", "\n\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


#: Page numbers, dotted leaders, form headers and rules of filings, in order of removal.
BOILERPLATE = (
    r"(?s)\n\s*-\s*\d+\s*-\s*\n",
    r"(?s)\.{5,}\s*\d+",
    r"(?s)UNITED STATES\s+SECURITIES AND EXCHANGE COMMISSION.*?FORM\s+\S+",
    r"(?s)={10,}",
    r"(?s)-{10,}",
)


def drop_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Words between white space: the default tokenizer."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


@dataclass(frozen=True)
class Tokenizer:
    """split: text to an array of tokens; join: such an array to text."""

    split: Callable[[Column], Column]
    join: Callable[[Column], Column]


WHITE_SPACE = Tokenizer(tokens, lambda words: F.array_join(words, " "))


def vocabulary_tokenizer(path: str) -> Tokenizer:
    """Tokens of a byte-level vocabulary file, the same path on all executors: texts of pieces, which joined give the text again.

    The library works on whole Arrow batches; where several tokens make one character, the first has it and the others are empty.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer as File

        file = File.from_file(path)
        for texts in batches:
            known = texts.fillna("").tolist()
            coded = file.encode_batch(known, add_special_tokens=False)
            yield pd.Series([_pieces(text, c.offsets) for text, c in zip(known, coded, strict=True)])

    return Tokenizer(split, lambda words: F.array_join(words, ""))


def _pieces(text: str, offsets: list[tuple[int, int]]) -> list[str]:
    """A string per token: its characters, or nothing where a token only goes on with a character that another began."""
    out, done = [], 0
    for begin, end in offsets:
        out.append(text[max(begin, done) : end])
        done = max(done, end)
    return out


def token_windows(words: Column, size: int = 512, overlap: int = 50) -> Column:
    """Arrays of ``size`` words, each beginning ``overlap`` words before the last one ended; one window for shorter arrays, none for empty ones."""
    n, step = F.size(words), size - overlap
    if step <= 0:
        return F.array(words)
    starts = F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.slice(words, s + 1, size))
