"""URL filter: rules by host and path, then a list of canonical URLs.

The list is met in two steps.  A blocked Bloom filter (blocks of eight 64-bit words,
one bit in each word, so a look-up reads one cache line) passes every listed URL and
a few others; only what passes joins the list itself, by the whole canonical URL,
which removes the false positives.  The filter's size follows the list up to
``most_bytes``; beyond that it passes more, and the join still decides.

Nulls and URLs without ``://`` have an empty host and path, fit no rule, and are on
no list; rows that repeat an id or URL are judged each for itself; an empty list
blocks nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, spill

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Query parameters that don't change what a page is.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without closing slashes, sorted query without tracking; null without ``://``."""
    rest = F.regexp_extract(_rest(url), r"^[^#]*", 0)
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(?s:(.*))$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest is asked first, so it stands outermost
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class BlockedBloom:
    """Bits of 64-bit hashes in blocks of eight words."""

    SALTS = np.array([0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31, 0xA2B7289D8824AD5B, 0x5C6BFB319EFC4947, 0x2DF1424B705495C7, 0x44974D9147B6137B], np.uint64)

    def __init__(self, words: np.ndarray) -> None:
        self.words = words.reshape(-1, 8)

    @staticmethod
    def blocks_for(n: int, most_bytes: int) -> int:
        """Blocks (a power of two) of 64 bytes for 16 bits an entry."""
        return 1 << max(0, min((n * 2 - 1) // 64, most_bytes // 64 - 1)).bit_length() if n else 1

    @classmethod
    def places(cls, h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and its bit in each of the eight words."""
        h = h.view(np.uint64)
        bits = (h[:, None] * cls.SALTS[None, :]) >> np.uint64(58)
        return ((h >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64), np.uint64(1) << bits

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], np.int64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        block, masks = self.places(h, len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)

    @classmethod
    def build(cls, hashes: DataFrame, n: int, most_bytes: int) -> BlockedBloom:
        """From a DataFrame of one column ``h``: words are combined where the hashes are, at most most_bytes come to the driver."""
        blocks = cls.blocks_for(n, most_bytes)

        def words(batches):
            import pyarrow as pa

            for batch in batches:
                if len(batch):
                    block, masks = cls.places(batch.column(0).to_numpy(zero_copy_only=False), blocks)
                    at = (block[:, None] * 8 + np.arange(8)).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(masks.reshape(-1).view(np.int64))], names=["at", "bits"])

        rows = hashes.select("h").mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        out = np.zeros(blocks * 8, np.int64)
        out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        return cls(out.view(np.uint64))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) per row: a rule's verdict, else block if the canonical URL is listed, else allow."""
    spark = pages.sparkSession
    blocked = spill(listed.select(canonical(F.col(listed_col).cast("string")).alias("canonical")).filter("canonical is not null").distinct(), "listed")
    n = blocked.count()
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(blocked.select(F.xxhash64("canonical").alias("h")), n, most_bytes).words)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).test(h.to_numpy(np.int64)))

    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    parsed = parsed.withColumn("fit", ruled(F.col("host"), F.col("path"), rules)).withColumn("maybe", F.col("canonical").isNotNull() & maybe(F.xxhash64("canonical")))
    small = (blocked.agg(F.sum(F.octet_length("canonical") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    columns = ["page_id", "host", "path", "fit"]
    if small:  # one pass: what doesn't pass the filter has no key and meets nothing
        exact = F.broadcast(blocked.select(F.col("canonical").alias("__key"), F.lit(True).alias("listed")))
        rows = parsed.withColumn("__passed", F.when(F.col("maybe"), F.col("canonical"))).join(exact, F.col("__passed") == F.col("__key"), "left")
        rows = rows.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    else:  # only what passes is shuffled
        passed = parsed.filter("maybe").join(blocked.withColumn("listed", F.lit(True)), "canonical", "left")
        rows = passed.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(parsed.filter("not maybe").select(*columns, F.lit(False).alias("listed")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")
