"""Filing lists and documents over HTTP: a Python data source, with one rate for all its tasks and calls that are repeated.

Companies are dealt to ``lanes`` partitions.  A lane starts its requests ``lanes /
rate`` seconds apart, the lanes ``1 / rate`` seconds after each other, so that all of
them together keep to ``rate`` requests a second, however many run at once; requests
that are repeated wait for their turn too.  A task that is run again fetches its own
companies again and nothing else.

A company or document that isn't there (404) is a row with a null body; any other
failure is repeated and then ends the task.  No companies give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .submissions import ARCHIVES, SUBMISSIONS, SourceError, retried, ten_digits

#: Requests a second, and where filing lists are.
RATE, LISTS = 8.0, "https://data.sec.gov/submissions"
AGENT = "lodestrata filings reader"


class Pace:
    """Turns of one lane: wait() returns when its next request may start."""

    def __init__(self, rate: float, lanes: int, lane: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.apart, self.clock, self.sleep = lanes / rate, clock, sleep
        self.next = clock() + lane / rate

    def wait(self) -> None:
        ahead = self.next - self.clock()
        if ahead > 0:
            self.sleep(ahead)
        self.next = max(self.next, self.clock()) + self.apart


def get(url: str, pace: Pace, attempts: int = 3, least: float = 2.0, most: float = 10.0, timeout: float = 30.0) -> str | None:
    """The text at url, None if there is nothing; every attempt waits for its turn."""

    def once() -> str | None:
        pace.wait()
        try:
            with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except HTTPError as failed:
            if failed.code == 404:
                return None
            raise SourceError(f"{url}: {failed.code}") from failed
        except OSError as failed:
            raise SourceError(f"{url}: {failed}") from failed

    return retried(once, attempts, least, most, on=SourceError)()


class _Lane(InputPartition):
    def __init__(self, number: int, companies: list[str]) -> None:
        super().__init__(number)
        self.number, self.companies = number, companies


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = options.get("base", LISTS).rstrip("/")
        self.rate, self.lanes = float(options.get("rate", RATE)), int(options.get("lanes", "4"))
        self.attempts, self.least, self.most = int(options.get("attempts", "3")), float(options.get("leastwait", "2")), float(options.get("mostwait", "10"))
        if self.rate <= 0 or self.lanes < 1:
            raise SourceError("rate and lanes must be positive")
        given = [c.strip() for c in options.get("companies", "").split(",")]
        self.companies = sorted({c.zfill(10) for c in given if c})

    def partitions(self) -> Sequence[InputPartition]:
        dealt = [self.companies[i :: self.lanes] for i in range(self.lanes)]
        return [_Lane(i, d) for i, d in enumerate(dealt) if d] or [_Lane(0, [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pace = Pace(self.rate, self.lanes, partition.number)
        for company in partition.companies:
            yield company, get(f"{self.base}/CIK{company}.json", pace, self.attempts, self.least, self.most)


class SubmissionLists(DataSource):
    """Format ``submission_lists``: (cik, body); options companies (numbers with commas), base, rate, lanes, attempts, leastWait, mostWait."""

    @classmethod
    def name(cls) -> str:
        return "submission_lists"

    def schema(self) -> str:
        return "cik string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def fetch_submissions(spark: SparkSession, companies: Sequence[str], **options: object) -> DataFrame:
    """What read_submissions() gives of landed lists, fetched; companies that have no list are left out."""
    spark.dataSource.register(SubmissionLists)
    reader = spark.read.format("submission_lists").option("companies", ",".join(companies))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    parsed = reader.load().filter("body is not null").select("cik", F.from_json("body", SUBMISSIONS).alias("x"))
    return parsed.select(ten_digits(F.coalesce("x.cik", "cik")).alias("cik"), F.col("x.filings").alias("filings"))


def fetch_documents(listed: DataFrame, base: str = ARCHIVES, rate: float = RATE, lanes: int = 4, attempts: int = 3, least: float = 2.0, most: float = 10.0) -> DataFrame:
    """listed filings (source_url, ...) with ``html`` and ``file_hash`` of their documents, both null where there is none; base: in the place of the archives' address.

    Rows are dealt evenly to ``lanes`` tasks, which keep to one rate; a task that is run
    again fetches its rows again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pace = Pace(rate, lanes, TaskContext.get().partitionId() % lanes)
        for batch in batches:
            urls = batch.column(batch.schema.get_field_index("source_url")).to_pylist()
            texts = [None if u is None else get(base.rstrip("/") + u.removeprefix(ARCHIVES), pace, attempts, least, most) for u in urls]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "html"])

    schema = StructType([*listed.schema.fields, StructField("html", StringType())])
    # by a number made from the url, so that a row stays in its lane when a task is lost
    lane = F.pmod(F.xxhash64("source_url"), F.lit(lanes))
    dealt = listed.repartitionByRange(lanes, lane, "source_url")
    return dealt.mapInArrow(run, schema).withColumn("file_hash", F.sha2(F.encode("html", "UTF-8"), 256))


__all__ = ["RATE", "Pace", "SubmissionLists", "fetch_documents", "fetch_submissions", "get"]
