"""Benchmark decontamination with DataFrame functions only.

A window is ``span`` consecutive words of an item, or a whole shorter item.  A
training text is first probed at every few words: a window of L words holds
L - g + 1 grams of g words, so grams at every (L - g + 1)-th word of a text can't
miss one that stands there.  Probes meet the items' grams in a hash set that is
broadcast while its measured size allows and shuffled beyond.  Only around probes
that meet are the windows themselves read, and they count if their words are equal,
not their hashes.

Nulls have no words.  Rows that repeat a doc_id are judged each for itself, rows
without one too; repeated items count once per item_id, items without an id mark
words but are not counted as items; an empty benchmark hits nothing and empty
documents give an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, RID, attach, identify, numbered, original, spill

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z, then words of letters, digits and everything beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    # ASCII texts take the quick way, with the same result
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, _BREAK), "")


def _gram(length: int) -> int:
    return (length + 2) // 2


def _hash(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.slice(words, start + 1, n))


def _starts(n: Column, size: int, step: int = 1) -> Column:
    """0, step, ... while size words follow; empty if there are fewer."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows_of(benchmark: DataFrame, span: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, at, words): the windows of all items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    sized = items.withColumn("size", F.least(F.size("ws"), F.lit(span)))
    at = sized.select("item_id", "size", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("size"))).alias("at"))
    return at.select("item_id", "size", "at", F.slice("ws", F.col("at") + 1, F.col("size")).alias("words"))


def _grams_of(size: int) -> Column:
    """Hashes of the grams of a window of so many words."""
    g = _gram(size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - g)), lambda i: _hash(F.col("words"), i, g))


def _probes(size: int) -> Column:
    """The grams of a text that windows of so many words can't miss: (size, place, hash)."""
    g = _gram(size)
    return F.transform(_starts(F.col("n"), g, size - g + 1), lambda p: F.struct(F.lit(size).alias("size"), p.alias("p"), _hash(F.col("ws"), p, g).alias("gram")))


def _bounded(df: DataFrame, each: Column) -> DataFrame:
    """df, marked for broadcast if its measured size allows."""
    size = df.agg(F.sum(each)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """(RID, start, size, items): where windows of the benchmark stand, and which items have them; docs from identify()."""
    windows = spill(windows_of(benchmark, span), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most span numbers
    if not sizes:
        return docs.select(RID, F.lit(0).alias("start"), F.lit(0).alias("size"), F.array(F.lit("")).alias("items")).limit(0)
    grams = None
    for size in sizes:
        own = windows.filter(F.col("size") == size).select("size", F.explode(_grams_of(size)).alias("gram"))
        grams = own if grams is None else grams.unionByName(own)
    grams = _bounded(spill(grams.distinct(), "grams"), F.lit(48))

    texts = docs.select(RID, words_of(F.col("text")).alias("ws")).withColumn("n", F.size("ws"))
    probes = [_probes(size) for size in sizes]
    probed = texts.select(RID, F.explode(F.concat(*probes)).alias("probe")).select(RID, "probe.size", "probe.p", "probe.gram")
    met = probed.join(grams, ["size", "gram"], "left_semi")
    near = spill(met.groupBy(RID).agg(F.collect_set(F.struct("size", "p")).alias("payload")), "probes")

    # every start whose window covers a probe that met
    near_texts = attach(docs.select(RID, "text"), near, how="inner", each=F.size("payload") * 16).select(RID, words_of(F.col("text")).alias("ws"), "payload").withColumn("n", F.size("ws"))
    cases = "CASE x.size " + " ".join(f"WHEN {s} THEN {_gram(s)}" for s in sizes) + " END"
    starts = F.expr(
        f"""array_distinct(flatten(transform(filter(payload, x -> n >= x.size), x ->
            transform(sequence(greatest(0, least(x.p + {cases} - x.size, n - x.size)), greatest(0, least(x.p, n - x.size))), s -> struct(x.size AS size, s AS start)))))"""
    )
    candidates = near_texts.select(RID, "ws", F.explode(starts).alias("w")).select(RID, "w.size", "w.start", F.slice("ws", F.col("w.start") + 1, F.col("w.size")).alias("words"))
    # a window that many items share is one row, so that a place in a text meets it once
    listed = spill(windows.groupBy("size", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "listed-windows")
    listed = _bounded(listed, F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", "    ")) + 64)
    return candidates.join(listed, ["size", "words"]).select(RID, "start", "size", "items")


def judge(docs: DataFrame, benchmark: DataFrame, span: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", detail: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs; detail adds hit_words (their numbers) and RID.

    A document is contaminated if words of it are hit and they are at least one in ``one_in``.
    """
    benchmark = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    docs = identify(docs, id_col, text_col)
    found = hits(docs, benchmark, span)
    spans = F.collect_set(F.struct("start", "size"))
    by_doc = found.groupBy(RID).agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    by_doc = spill(by_doc.select(RID, covered.alias("payload"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "hits")
    counted = docs.select(RID, "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = attach(counted, by_doc, each=F.size("payload") * 4 + 128)
    n_hit = F.coalesce(F.size("payload"), F.lit(0)).cast("long")
    out = joined.select(
        RID,
        "doc_id",
        "n_words",
        F.when(F.col("payload").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("payload").alias("hit_words"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    return out if detail else out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", span: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with their hit words taken out and the others joined by spaces.

    All columns of docs stay.
    """
    rows = numbered(docs, id_col, text_col)
    verdicts = judge(rows, benchmark, span, one_in, id_col, text_col, detail=True)
    bad = spill(verdicts.filter("contaminated").select(RID, F.col("hit_words").alias("payload")), "contaminated")
    if remove == "documents":
        return original(attach(rows, bad.select(RID, F.lit(b"").alias("payload")), how="left_anti"), docs)
    if remove != "spans":
        raise ValueError(f"remove: documents or spans, not {remove}")
    joined = attach(rows, bad.withColumnRenamed("payload", "__ls_hit"), each=F.size("__ls_hit") * 4 + 64)
    joined = joined.withColumn("__ls_words", F.when(F.col("__ls_hit").isNotNull(), words_of(F.col(text_col))))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ls_words") - 1), F.col("__ls_hit"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__ls_words", i)), " ")
    return original(joined.withColumn(text_col, F.when(F.col("__ls_hit").isNull(), F.col(text_col)).otherwise(kept)), docs)
