"""Filing lists in the form of parallel arrays, their documents, and the landing area."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FILING_TYPES

SUBMISSIONS = "cik string, filings struct<recent struct<accessionNumber array<string>, form array<string>, filingDate array<string>, primaryDocument array<string>>>"
#: Fixed value: where documents of filings are.
ARCHIVES = "https://www.sec.gov/Archives/edgar/data"
#: Years of filings that can be listed at once.
MOST_YEARS = 5


class SourceError(ValueError):
    """A source doesn't have what was asked for, or can't."""


def retried(f: Callable, attempts: int = 3, least: float = 2.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep, on: type[Exception] | tuple = Exception) -> Callable:
    """f, called again after an error, at most ``attempts`` times, with waits that double between least and most seconds."""

    def call(*args, **kwargs):
        for n in range(1, attempts + 1):
            try:
                return f(*args, **kwargs)
            except on:
                if n == attempts:
                    raise
                sleep(min(most, max(least, 2.0 ** (n - 1))))

    return call


def read_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Filing lists that were landed as JSON, a file for each company, with ten-digit ``cik``."""
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(folder).withColumn("cik", ten_digits(F.col("cik")))


def ten_digits(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def resolve(tickers: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """tickers (ticker) with their ten-digit ``cik``, compared in upper case; those nobody knows are dropped, or strict: an error when read."""
    names = known.select(F.upper("ticker").alias("ticker"), ten_digits(F.col("cik")).alias("cik")).dropDuplicates(["ticker"])
    out = tickers.select(F.upper("ticker").alias("ticker")).join(names, "ticker", "left" if strict else "inner")
    unknown = F.raise_error(F.concat(F.lit("unknown ticker "), F.coalesce("ticker", F.lit("null"))))
    return out.withColumn("cik", F.coalesce("cik", unknown)) if strict else out


def filings(submissions: DataFrame, form: str, years: int) -> DataFrame:
    """(cik, fiscal_year, filed_at, accession, document, source_url) of a form: the first filing of each calendar year in source order, of the first ``years`` filings; malformed entries are skipped, entries without a date have no year."""
    recent = F.col("filings.recent")
    zipped = F.arrays_zip(recent["accessionNumber"].alias("accession"), recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["primaryDocument"].alias("document"))
    rows = submissions.select("cik", F.posexplode(zipped).alias("pos", "f")).filter(F.col("f.form") == form)
    blank = F.coalesce(F.col("f.filed") == "", F.lit(True))
    rows = rows.select("cik", "pos", blank.alias("blank"), F.try_to_date("f.filed", "yyyy-MM-dd").alias("filed_at"), F.replace("f.accession", F.lit("-"), F.lit("")).alias("accession"), F.coalesce("f.document", F.lit("")).alias("document"))
    rows = rows.filter("(filed_at is not null or blank) and accession is not null").withColumn("fiscal_year", F.year("filed_at"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("cik", "fiscal_year").orderBy("pos"))).filter("k = 1 or fiscal_year is null")
    out = first.withColumn("k", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).filter(F.col("k") <= years)
    return out.select("cik", "fiscal_year", "filed_at", "accession", "document", source_url(F.col("cik"), F.col("accession"), F.col("document")).alias("source_url"))


def source_url(cik: Column, accession: Column, document: Column) -> Column:
    """Where a document is: the number of the company without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(ARCHIVES), cik.cast("long").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def list_filings(tickers: DataFrame, filing_type: str, known: DataFrame, submissions: DataFrame, years: int = 3) -> DataFrame:
    """(ticker, filing_type, cik, fiscal_year, filed_at, accession, document, source_url) of tickers (ticker), newest first by source.

    An unsupported type is an error, an unknown ticker too; more than MOST_YEARS years are cut to that.
    """
    if filing_type not in FILING_TYPES:
        raise SourceError(f"filing_type: one of {', '.join(FILING_TYPES)}, not {filing_type}")
    if years < 1:
        raise SourceError(f"years: 1 to {MOST_YEARS}, not {years}")
    found = resolve(tickers, known, strict=True)
    wanted = submissions.withColumn("cik", ten_digits(F.col("cik"))).join(found.select("cik"), "cik", "left_semi")
    rows = filings(wanted, filing_type, min(years, MOST_YEARS)).join(found, "cik")
    return rows.select("ticker", F.lit(filing_type).alias("filing_type"), "cik", "fiscal_year", "filed_at", "accession", "document", "source_url")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html, file_hash) of landed pages; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("html"), F.sha2("content", 256).alias("file_hash"))


LANDING = ("ticker", "filing_type", "fiscal_year")


def land(pages: DataFrame, root: str) -> None:
    """Adds pages (ticker, filing_type, fiscal_year, html) to the landing area: a folder per ticker, type and year (``FY2024``)."""
    safe = pages.select(F.replace("ticker", F.lit("/"), F.lit("_")).alias("ticker"), "filing_type", F.concat(F.lit("FY"), F.col("fiscal_year").cast("string")).alias("fiscal_year"), "html")
    safe.write.mode("append").partitionBy(*LANDING).parquet(root)


def landed_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the landing area with their hashes; only the folders that a filter names are read."""
    rows = spark.read.schema("html string, ticker string, filing_type string, fiscal_year string").parquet(root)
    return rows.withColumn("fiscal_year", F.substring("fiscal_year", 3, 10).cast("int")).withColumn("file_hash", F.sha2(F.encode("html", "UTF-8"), 256))


def not_landed(wanted: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Filings (ticker, filing_type, fiscal_year, ...) that the landing area doesn't have yet; only its folder names are read."""
    have = landed_pages(spark, root).select(*LANDING).distinct()
    return wanted.join(have, list(LANDING), "left_anti")


def with_documents(listed: DataFrame, documents: DataFrame, columns: Sequence[str] = ("html", "file_hash")) -> DataFrame:
    """Listed filings with the documents that were fetched for them; documents: (path, html, file_hash), the path's end being the filing's accession and document."""
    key = lambda path: F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))
    fetched = documents.select(key(F.col("path")).alias("__key"), *columns)
    return listed.withColumn("__key", F.concat_ws("/", "accession", "document")).join(fetched, "__key").drop("__key")
