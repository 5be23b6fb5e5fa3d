"""Vector search by coarse cells: a table laid out by cell, of which a question reads the nearest ones.

Cells are fitted by spherical k-means on a bounded sample (``sample`` rows, those with
the smallest hashes of their ids); every row is indexed.  Within the cells that are
probed the search is exact, so a search of all cells is the exact search; how many
nearest neighbours fewer probes miss is measured by recall().  How many cells a search
probes by default is fitted too: as few as find ``target`` of the sample's own nearest
neighbours, measured on up to 256 of its rows.

Null vectors and those of length 0 are in cell 0; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval as R

#: Fixed value: cells of the surveyed index.
CELLS = 100


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length == 0, 1, length)


def _enough(points: np.ndarray, centres: np.ndarray, target: float, k: int = R.TOP_K, queries: int = 256) -> int:
    """How many of the nearest cells hold the share ``target`` of the k nearest others of some points."""
    asked = np.linspace(0, len(points) - 1, min(queries, len(points))).astype(np.int64)
    own = (points @ centres.T).argmax(axis=1)
    alike = points[asked] @ points.T
    alike[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-alike, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    if not near.size:
        return 1
    place = np.argsort(np.argsort(-(points[asked] @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a point's order
    found = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
    return int(found[max(0, int(np.ceil(target * len(found))) - 1)]) + 1


@dataclass(frozen=True)
class Cells:
    """centres: a unit vector per cell; probes: cells that a search reads unless it says otherwise."""

    centres: np.ndarray
    probes: int = 10

    @classmethod
    def fit(cls, chunks: DataFrame, cells: int = CELLS, sample: int = 20_000, rounds: int = 10, id_col: str = "id", vector_col: str = "embedding", target: float = 0.95) -> Cells:
        rows = chunks.filter(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector_col).cast("array<double>").alias("v")).toPandas()
        if not len(rows):
            return cls(np.zeros((1, 1)))
        points = _unit(np.stack(rows["v"].to_numpy()))
        centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(np.int64)]
        for _ in range(rounds):
            own = (points @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            filled = np.bincount(own, minlength=len(centres)) > 0
            centres = np.where(filled[:, None], _unit(sums), centres)
        return cls(centres, _enough(points, centres, target))

    def assigned(self, chunks: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """chunks with ``cell``, the number of the nearest centre."""
        centres = self.centres

        @F.pandas_udf("int")
        def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                out = np.zeros(len(vectors), np.int32)
                known = np.flatnonzero(vectors.notna().to_numpy())
                if len(known):
                    out[known] = (_unit(np.stack(vectors.to_numpy()[known]).astype(np.float64)) @ centres.T).argmax(axis=1)
                yield pd.Series(out)

        return chunks.withColumn("cell", cell(F.col(vector_col)))

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        """The cells whose centres are nearest to a query, the nearest first."""
        if self.centres.shape[1] != len(query):
            return [0]
        return np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")[:probes].tolist()


def write_index(chunks: DataFrame, cells: Cells, path: str, vector_col: str = "embedding") -> None:
    """Chunks in a folder per cell, and the centres beside them."""
    spark = chunks.sparkSession
    # a large cell is dealt to several tasks, a small one is one file
    laid = cells.assigned(chunks, vector_col)
    laid.repartition("cell", F.pmod(F.xxhash64(vector_col), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist(), cells.probes) for i, c in enumerate(cells.centres)], "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
    return spark.read.parquet(f"{path}/cells"), Cells(np.stack(rows["centre"].to_numpy()), int(rows["probes"].iloc[0]))


def search(index: DataFrame, cells: Cells, query: Sequence[float], k: int = R.TOP_K, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score, rank) of the best in the nearest cells; other cells' folders aren't read."""
    return R.cosine_topk(index.filter(F.col("cell").isin(cells.nearest(query, cells.probes if probes is None else probes))), query, k, id_col, vector_col)


def recall(index: DataFrame, cells: Cells, queries: Sequence[Sequence[float]], k: int = R.TOP_K, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> float:
    """The share of the exact k nearest that the probes find, over a few queries."""
    found = wanted = 0
    for q in queries:
        exact = {r["id"] for r in R.cosine_topk(index, q, k, id_col, vector_col).collect()}
        found += len(exact & {r["id"] for r in search(index, cells, q, k, probes, id_col, vector_col).collect()})
        wanted += len(exact)
    return found / max(1, wanted)
