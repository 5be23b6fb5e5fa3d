"""Ranked retrieval: cosine and trigram top-k, MMR, fusion, thresholds, context packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NO_WORD, trigram_similarity, trigrams
from ..functions.vectors import cosine

#: Default parameters.
TOP_K, FETCH_K, LAMBDA, RRF_K, ALPHA, OVER_FETCH, THRESHOLD, BUDGET = 5, 20, 0.5, 60, 0.7, 3, 0.7, 6000


def where(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows with the wanted values; a false value (empty, zero, none) means no condition; upper_<column> compares in upper case."""
    for name, value in wanted.items():
        if value:
            column = name.removeprefix("upper_")
            df = df.filter(F.col(column) == (str(value).upper() if name != column else value))
    return df


def cosine_scores(chunks: DataFrame, query: Sequence[float], id_col: str, vector_col: str) -> DataFrame:
    """(id, score) of all chunks."""
    return chunks.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows by score, then id, with their rank; partitions keep only their own k before anything moves."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def cosine_topk(chunks: DataFrame, query: Sequence[float], k: int = TOP_K, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    return top_k(cosine_scores(chunks, query, id_col, vector_col), k)


def above(ranked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of at least the threshold; a score that is no number never passes."""
    return ranked.filter((F.col("score") >= threshold) & ~F.isnan("score"))


def trigram_topk(docs: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The k texts most similar to the query by trigrams; a text is cut into trigrams once and only its score moves."""
    wanted = trigrams(F.lit(query))
    scored = docs.select(F.col(id_col).alias("id"), trigram_similarity(trigrams(F.col(text_col)), wanted).alias("score"))
    return top_k(scored, k)


def trigram_postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(gram, id, n): a row per text and trigram; n: how many trigrams the text has."""
    cut = docs.select(F.col(id_col).alias("id"), trigrams(F.col(text_col)).alias("__grams"))
    return cut.select("id", F.size("__grams").alias("n"), F.explode("__grams").alias("gram")).select("gram", "id", "n")


def write_trigram_index(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Postings sorted by trigram, so that a question reads the row groups of its own trigrams only."""
    spread = postings.repartition(files, "gram") if files else postings.repartition("gram")
    spread.sortWithinPartitions("gram", "id").write.option("parquet.block.size", 4 << 20).parquet(path)


#: Bytes of text whose postings are made at once.
BLOCK_BYTES = 8 << 20


def _block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(gram, ids, ns) of a block of texts, by trigram; texts: lower-cased words with blanks between them."""
    words = pc.split_pattern(texts, " ")
    text_of, words = pc.list_parent_indices(words).to_numpy().astype(np.int64), pc.list_flatten(words)
    some = pc.not_equal(words, "")
    text_of, words = text_of[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    # a word is cut once, as words repeat: two blanks, its characters and a blank, of which the last begins no trigram
    size = pc.utf8_length(words.dictionary).to_numpy().astype(np.int64) + 3
    chars = np.frombuffer("".join(f"  {w} " for w in words.dictionary.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    last = np.zeros(len(chars) + 2, bool)
    last[np.cumsum(size) - 1] = True
    chars = np.append(chars, [0, 0])
    begins = np.flatnonzero(~last[:-2])
    third = np.where(last[begins + 1], 0, chars[begins + 2])
    codes, gram = np.unique(chars[begins] << 42 | chars[begins + 1] << 21 | third, return_inverse=True)
    n_texts, n_words = max(len(texts), 1), max(len(size), 1)
    pairs = np.unique(text_of * n_words + words.indices.to_numpy().astype(np.int64))
    text_of, word = pairs // n_words, pairs % n_words
    each, first = size - 1, np.cumsum(size - 1) - (size - 1)
    times = each[word]
    at = np.repeat(first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    pairs = np.unique(gram[at] * n_texts + np.repeat(text_of, times))
    gram, text_of = pairs // n_texts, pairs % n_texts
    borders = pa.array(np.searchsorted(gram, np.arange(len(codes) + 1)), pa.int32())
    spelled = ["".join(chr(c) for c in (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF) if c) for x in codes.tolist()]
    n = np.bincount(text_of, minlength=n_texts).astype(np.int32)[text_of]
    lists = [pa.ListArray.from_arrays(borders, values) for values in (ids.take(pa.array(text_of)), pa.array(n))]
    return pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), *lists], names=["gram", "ids", "ns"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, len(batch) * BLOCK_BYTES // max(batch.nbytes, 1))
        for a in range(0, len(batch), step):
            part = batch.slice(a, step)
            yield _block(part.column(0), part.column(1).cast(pa.string()))


def write_trigram_blocks(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """The postings of docs where the texts are: a row for each trigram of a block of texts, with the texts' ids and numbers of trigrams.

    Nothing is shuffled or sorted beyond a block, so time and bytes are in proportion to the texts.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.regexp_replace(F.lower(text_col), NO_WORD, " ").alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    rows.mapInArrow(_blocks, f"gram string, ids array<{kind}>, ns array<int>").write.option("parquet.block.size", 4 << 20).parquet(path)


def open_trigram_blocks(spark: SparkSession, path: str) -> DataFrame:
    """trigram_postings() of a written index; a condition on trigrams holds before a list is taken apart."""
    each = spark.read.parquet(path).select("gram", F.explode(F.arrays_zip("ids", "ns")).alias("x"))
    return each.select("gram", F.col("x.ids").alias("id"), F.col("x.ns").alias("n"))


def indexed_trigram_topk(index: DataFrame, docs: DataFrame, query: str, k: int, id_col: str = "id", among: DataFrame | None = None) -> DataFrame:
    """trigram_topk() from postings: the same rows.  docs: the indexed texts (only ids are read, and only if fewer than k share a trigram); among: (id) of those that may be found."""
    spark = index.sparkSession
    wanted = spark.range(1).select(trigrams(F.lit(query)).alias("g")).first()[0]
    shared = index.filter(F.col("gram").isin(wanted)) if wanted else index.limit(0)
    shared = shared.groupBy("id").agg(F.count("*").alias("both"), F.first("n").alias("n"))
    scored = shared.select("id", (F.col("both") / (F.col("n") + F.lit(len(wanted)) - F.col("both")).cast("double")).alias("score"))
    pool = docs.select(F.col(id_col).alias("id")) if among is None else among.select("id")
    if among is not None:
        scored = scored.join(among.select("id"), "id", "left_semi")
    best = top_k(scored, k)
    if len(scored.take(k)) < k:  # the rest shares nothing and follows by id
        rest = pool.join(scored.select("id"), "id", "left_anti").orderBy("id").limit(k).withColumn("score", F.lit(0.0))
        best = top_k(scored.unionByName(rest), k)
    return best


def mmr(chunks: DataFrame, query: Sequence[float], k: int = TOP_K, fetch_k: int = FETCH_K, weight: float = LAMBDA, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, score): the best match, then each time the candidate with the greatest weight * score - (1 - weight) * likeness to those chosen.

    Only fetch_k candidates reach the one task that chooses.
    """
    scored = chunks.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"), F.col(vector_col).cast("array<double>").alias("v"))
    candidates = scored.orderBy(F.desc("score"), "id").limit(fetch_k)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        v = np.stack(rows["v"].to_numpy())
        length = np.sqrt((v * v).sum(axis=1))
        unit = v / np.where(length == 0, 1, length)[:, None]
        s, alike = rows["score"].to_numpy(), np.full(len(rows), -np.inf)
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            value = s if not chosen else weight * s - (1 - weight) * alike
            value = np.where(np.isin(np.arange(len(rows)), chosen), -np.inf, value)
            best = int(value.argmax())  # the first of equals
            chosen.append(best)
            alike = np.maximum(alike, unit @ unit[best])
        return pd.DataFrame({"id": rows["id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1), "score": s[chosen]})

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(choose, f"id {kind}, rank long, score double")


def fuse(vector: DataFrame, text: DataFrame, k: int, alpha: float = ALPHA, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank): an absent side adds nothing."""
    v, t = vector.select("id", F.col("rank").alias("vector_rank")), text.select("id", F.col("rank").alias("text_rank"))
    both = v.join(t, "id", "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return top_k(both.withColumn("score", part(alpha, "vector_rank") + part(1 - alpha, "text_rank")), k)


def hybrid(chunks: DataFrame, docs: DataFrame, query: Sequence[float], words: str, k: int = TOP_K, chunk_id: str = "id", vector_col: str = "embedding", doc_id: str = "id", text_col: str = "text", index: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Fusion of the vector and the trigram list, each fetched several times as long; the two sides are independent stages.

    index: postings of docs' trigrams, if there are any; among: (id) of the indexed texts that may be found.
    """
    n = OVER_FETCH * k
    text = trigram_topk(docs, words, n, doc_id, text_col) if index is None else indexed_trigram_topk(index, docs, words, n, doc_id, among)
    return fuse(cosine_topk(chunks, query, n, chunk_id, vector_col), text, k)


def late(ranked: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The whole rows of a short ranked list; the list is a few rows by its limit and is broadcast."""
    return rows.join(F.broadcast(ranked.withColumnRenamed("id", id_col)), id_col)


def upgraded(similar: DataFrame, hybrid_list: DataFrame | Callable[[], DataFrame], threshold: float) -> DataFrame:
    """(id, rank, score, search_type): what of the similarity list reaches the threshold, or the hybrid list if its best score doesn't (or there is none).

    The best score, one row, decides before either list is made, so only one of them runs.
    """
    best = similar.agg(F.max("score")).first()[0]
    if best is not None and best >= threshold:
        return above(similar, threshold).select("id", "rank", "score", F.lit("similarity").alias("search_type"))
    mixed = hybrid_list() if callable(hybrid_list) else hybrid_list
    return mixed.select("id", "rank", "score", F.lit("hybrid").alias("search_type"))


def per_group_topk(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k best of each group; the window keeps k rows of a group per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def header(ticker: Column, filing_type: Column, year: Column, section: Column, score: Column) -> Column:
    """``[Source: T TYPE FYyyyy — Section (score=0.850)]``."""
    year, section = F.coalesce(year.cast("string"), F.lit("None")), F.coalesce(section, F.lit("General"))
    return F.concat(F.lit("[Source: "), ticker, F.lit(" "), filing_type, F.lit(" FY"), year, F.lit(" — "), section, F.lit(" (score="), F.format_string("%.3f", score), F.lit(")]"))


def within_budget(ranked: DataFrame, tokens_col: str, budget: int = BUDGET, by: str | None = None) -> DataFrame:
    """The rows before the first that would exceed the budget, with the running total in ``used_tokens``."""
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used_tokens", F.sum(tokens_col).over(window)).filter(F.col("used_tokens") <= budget)


def year_context(blocks: DataFrame, block_col: str, year_col: str = "fiscal_year", shown: int = 2, nothing: str = "") -> DataFrame:
    """One row ``context``: under a header per year its ``shown`` first blocks, years in the order of ``nth``, or ``nothing`` where there are none."""
    place = F.row_number().over(Window.partitionBy("nth", year_col).orderBy("rank"))  # ranks may have gaps
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(block_col).alias("block"))))
    by_year = blocks.withColumn("__place", place).filter(F.col("__place") <= shown).groupBy("nth", year_col).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias("text"))
    part = F.concat(F.lit("=== FY"), F.col(year_col).cast("string"), F.lit(" ===\n"), F.col("text"))
    years = F.array_sort(F.collect_list(F.struct("nth", part.alias("part"))))
    joined = F.array_join(F.transform(years, lambda y: y["part"]), "\n\n")
    return by_year.agg(F.when(F.count("*") > 0, joined).otherwise(F.lit(nothing)).alias("context"))


def shortened(text: Column, most: int = 500) -> Column:
    """The first characters of a tool's result."""
    return F.substring(text, 1, most)


def joined_context(blocks: DataFrame, block_col: str, between: str = "\n\n---\n\n", nothing: str = "") -> DataFrame:
    """One row ``context``: the blocks in the order of rank, or ``nothing`` where there are none."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(block_col).alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda b: b["block"]), between)
    return blocks.agg(F.when(F.count("*") > 0, joined).otherwise(F.lit(nothing)).alias("context"))
