"""Vector quantizers: scalar (8 bits), binary and product codes, fitted by aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators.search import rounded


# ---------------------------------------------------------------- scalar
def scalar_fit(points: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row (low, scale): per-dimension minimum and (range, at least 1e-8) / 255."""
    parts = points.select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("a"), F.max(F.col("x").cast("double")).alias("b"))
    rows = F.array_sort(F.collect_list(F.struct("i", "a", (F.greatest(F.col("b") - F.col("a"), F.lit(1e-8)) / 255).alias("s"))))  # one per dimension
    return parts.agg(rows.alias("r")).select(F.transform("r", lambda r: r["a"]).alias("low"), F.transform("r", lambda r: r["s"]).alias("scale"))


def scalar_encode(points: DataFrame, model: DataFrame, vector_col: str = "vector") -> DataFrame:
    """points with code: floor of the scaled components, clipped to 0..255; and low, scale."""
    steps = F.zip_with(F.zip_with(F.col(vector_col), "low", lambda x, a: x.cast("double") - a), "scale", lambda x, s: x / s)
    code = F.transform(steps, lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(255)).cast("int"))
    return points.crossJoin(F.broadcast(model)).withColumn("code", code)


def scalar_decode(code: Column | str = "code") -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.zip_with(F.zip_with(c, F.col("scale"), lambda x, s: x * s), F.col("low"), lambda x, a: x + a)


def quantization_error(coded: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Mean and greatest relative error |v - decoded| / |v|."""
    e = V.euclidean(vector_col, scalar_decode()) / F.greatest(V.norm(vector_col), F.lit(1e-8))
    return coded.agg(rounded(F.avg(e)).alias("mean_error"), rounded(F.max(e)).alias("max_error"))


# ---------------------------------------------------------------- binary
def binary_thresholds(points: DataFrame, vector_col: str = "vector", median: bool = False) -> DataFrame:
    """One row (threshold): zeros, or per-dimension medians."""
    parts = points.select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg((F.percentile(F.col("x").cast("double"), F.lit(0.5)) if median else F.lit(0.0)).alias("t"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda r: r["t"]).alias("threshold"))


def binary_encode(points: DataFrame, model: DataFrame, vector_col: str = "vector") -> DataFrame:
    """points with bits (component above threshold) and words: 32 bits in each, most significant first."""
    bits = F.zip_with(F.col(vector_col), F.col("threshold"), lambda x, t: (x.cast("double") > t).cast("long"))
    words = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("bits") / 32).cast("int") - 1),
        lambda w: F.aggregate(F.slice("bits", w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda a, b: a * 2 + b),
    )
    return points.crossJoin(F.broadcast(model)).withColumn("bits", bits).withColumn("words", words)


def binary_distance(a, b, size: int) -> Column:
    """Share of differing bits."""
    return V.hamming(a, b) / size


def binary_asymmetric(bits: Column, query: list[float]) -> Column:
    """1 - (unit query times signs / dimension + 1) / 2: a float query against codes."""
    n = float(np.sqrt(sum(x * x for x in query))) or 1.0
    signs = F.transform(bits, lambda b: b.cast("double") * 2 - 1)
    return 1 - (V.dot(signs, [x / n for x in query]) / len(query) + 1) / 2


# ---------------------------------------------------------------- product
def product_fit(points: DataFrame, parts: int, centroids: int = 256, seed: int = 7, vector_col: str = "vector", iterations: int = 20) -> np.ndarray:
    """Codebooks (parts, centroids, width), by k-means on each slice. Their size does not depend on the data."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width = points.select(F.size(vector_col)).head()[0] // parts
    books = []
    for p in range(parts):
        piece = points.select(array_to_vector(F.slice(F.transform(vector_col, lambda x: x.cast("double")), p * width + 1, width)).alias("features"))
        model = KMeans(k=centroids, seed=seed, maxIter=iterations, initMode="k-means||").fit(piece)
        found = np.array(model.clusterCenters())
        books.append(np.vstack([found, np.repeat(found[:1], centroids - len(found), axis=0)]))
    return np.stack(books)


def product_encode(points: DataFrame, books: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """points with code: the nearest centroid of each slice."""
    shared = points.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        b = shared.value
        x = np.stack(v.to_numpy()).astype(float).reshape(len(v), b.shape[0], b.shape[2])
        codes = [((x[:, p, None, :] - b[p][None]) ** 2).sum(-1).argmin(1) for p in range(b.shape[0])]
        return pd.Series(np.stack(codes, 1).tolist())

    return points.withColumn("code", run(vector_col))


def product_decode(code: list[int], books: np.ndarray) -> list[float]:
    return np.concatenate([books[p, c] for p, c in enumerate(code)]).tolist()


def product_distance(query: list[float], books: np.ndarray, metric: str = "euclidean", code: str = "code") -> Column:
    """Sum of a query's table entries over a code: squared distance, negated dot product, or 1 - dot / |q|."""
    q = np.array(query, float).reshape(books.shape[0], books.shape[2])
    table = ((books - q[:, None]) ** 2).sum(-1) if metric == "euclidean" else (books * q[:, None]).sum(-1)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    total = F.aggregate(F.zip_with(F.col(code), rows, lambda c, t: F.get(t, c)), F.lit(0.0), lambda a, x: a + x)
    if metric == "euclidean":
        return total
    return -total if metric == "dot" else 1 - total / (float(np.sqrt((q * q).sum())) or 1.0)


def codebook_stats(books: np.ndarray) -> dict[str, float]:
    n = np.sqrt((books**2).sum(-1))
    return {"mean_norm": float(n.mean()), "std_norm": float(n.std())}
