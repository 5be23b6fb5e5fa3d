"""Schemas of filings, chunks and the audit log, and their row constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the stored tables.
FILINGS = (
    "id string not null, ticker string not null, filing_type string not null, fiscal_year smallint, fiscal_quarter smallint, filed_at date, source_url string, "
    "file_hash string, pages int, ingested_at timestamp, ingested_by string, is_active boolean not null"
)
CHUNKS = (
    "id string not null, filing_id string not null, ticker string not null, filing_type string not null, fiscal_year smallint, section string, chunk_index int not null, "
    "chunk_text string not null, token_count int, embedding array<float> not null, metrics map<string,double>, entities string, sentiment_score float, created_at timestamp, model_version string"
)
HISTORY = (
    "id string not null, question string not null, answer string, agent_type string, analysis_style string, search_type string, ticker string, source_chunk_ids array<string>, "
    "latency_ms int, error string, session_id string, created_at timestamp"
)
MIGRATIONS = "version string not null, description string, applied_at timestamp"

#: What columns of a closed set may hold.
FILING_TYPES = ("10-K", "10-Q", "8-K", "20-F", "DEF 14A", "S-1")
STYLES = ("analyst", "executive", "risk")
#: A stored search type may also be hybrid or agent, which the surveyed table's own check forbids although its writers use both.
SEARCH_TYPES = ("similarity", "mmr", "hybrid")
#: How many results and years a request may ask for.
LIMITS, YEARS = (1, 20), (1, 5)


def _maybe(value: Column, holds: Column) -> Column:
    """A constraint as databases read it: a null passes."""
    return value.isNull() | holds


def filing_checks() -> dict[str, Column]:
    return {
        "filing_type": _maybe(F.col("filing_type"), F.col("filing_type").isin(*FILING_TYPES)),
        "fiscal_quarter": _maybe(F.col("fiscal_quarter"), F.col("fiscal_quarter").between(1, 4)),
    }


def chunk_checks() -> dict[str, Column]:
    return {
        "chunk_index": _maybe(F.col("chunk_index"), F.col("chunk_index") >= 0),
        "token_count": _maybe(F.col("token_count"), F.col("token_count") > 0),
        "sentiment_score": _maybe(F.col("sentiment_score"), F.col("sentiment_score").between(-1.0, 1.0) & ~F.isnan("sentiment_score")),
    }


def history_checks() -> dict[str, Column]:
    return {
        "analysis_style": _maybe(F.col("analysis_style"), F.col("analysis_style").isin(*STYLES)),
        "search_type": _maybe(F.col("search_type"), F.col("search_type").isin(*SEARCH_TYPES, "agent")),
    }


def request_checks() -> dict[str, Column]:
    """Requests (question, analysis_style, search_type, limit, years): a question must be there, the rest may be absent."""
    return {
        "question": F.coalesce(F.trim("question") != "", F.lit(False)),
        "analysis_style": _maybe(F.col("analysis_style"), F.col("analysis_style").isin(*STYLES)),
        "search_type": _maybe(F.col("search_type"), F.col("search_type").isin(*SEARCH_TYPES)),
        "limit": _maybe(F.col("limit"), F.col("limit").between(*LIMITS)),
        "years": _maybe(F.col("years"), F.col("years").between(*YEARS)),
    }


def validate(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy every check, the others with the names of what they violate in ``violations``)."""
    failed = F.array_compact(F.array(*(F.when(~holds, F.lit(name)) for name, holds in checks.items())))
    good = reduce(lambda a, b: a & b, checks.values())
    return df.filter(good), df.withColumn("violations", failed).filter(F.size("violations") > 0)
