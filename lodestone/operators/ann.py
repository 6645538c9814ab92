"""Approximate nearest neighbours by an inverted file: cells around centres, of which a query probes a few.

Centres are fitted by k-means on a bounded sample (SAMPLE rows); every point is indexed. Exact search stays the
default of the engine; recall() measures what an index loses against it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import search

#: Rows that centres are fitted on, at most.
SAMPLE = 20_000


@dataclass(frozen=True)
class Cells:
    """Centres of an inverted file. Metric cosine compares directions, others distances."""

    centres: np.ndarray
    metric: str = "cosine"

    @classmethod
    def fit(cls, points: DataFrame, cells: int, metric: str = "cosine", rounds: int = 10, vector_col: str = "vector", order: str = "id") -> "Cells":
        """k-means on the SAMPLE rows of least hash; the first centres are spread out."""
        rows = points.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(order), order).limit(SAMPLE).select(vector_col).collect()
        if not rows:
            return cls(np.zeros((0, 0)), metric)
        x = _direction(np.array([r[0] for r in rows], float), metric)
        picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(picked) < min(cells, len(x)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        c = x[picked]
        for _ in range(rounds):
            at = _nearest(x, c)
            for i in range(len(c)):
                if (at == i).any():
                    c[i] = x[at == i].mean(axis=0)
        return cls(_direction(c, metric), metric)

    def index(self, points: DataFrame, vector_col: str = "vector") -> DataFrame:
        """points with the column cell (null without a vector of the index's length); write it partitioned by cell so that
        probes read their cells alone."""
        schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell: list[int | None] = [None] * batch.num_rows
                vectors = batch.column(batch.schema.names.index(vector_col)).to_pylist()
                here = [i for i, v in enumerate(vectors) if v is not None and len(v) == self.centres.shape[1] and None not in v]
                if here and len(self.centres):
                    at = _nearest(_direction(np.array([vectors[i] for i in here], float), self.metric), self.centres)
                    for i, c in zip(here, at.tolist()):
                        cell[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

        return points.mapInArrow(run, schema)

    def probes(self, query: Sequence[float], n: int) -> list[int]:
        q = _direction(np.array([list(query)], float), self.metric)
        return np.argsort(((self.centres - q) ** 2).sum(axis=1), kind="stable")[:n].tolist() if len(self.centres) else []

    def search(self, indexed: DataFrame, query: Sequence[float], k: int = 10, probes: int = 8, **options) -> DataFrame:
        """The k best of the probed cells, exactly scored; options as for vector_search."""
        return search.vector_search(indexed.where(F.col("cell").isin(self.probes(query, probes))), query, k, self.metric, **options)


def _direction(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30) if metric == "cosine" else x


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (id) that were found."""
    total = exact.count()
    return exact.join(found.select("id"), "id", "left_semi").count() / total if total else 1.0
