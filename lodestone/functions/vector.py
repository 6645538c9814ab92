"""Vector algebra as Column expressions over arrays of numbers. Sums run in array order, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    """A column by name, a Column, or a Python sequence as a literal array of doubles."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _zip(a, b, f) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double"))))


def dot(a, b) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """0 where either vector has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.when(scale.isNotNull(), F.lit(0.0)))


def cosine_distance(a, b) -> Column:
    return 1 - cosine_similarity(a, b)


def squared_euclidean(a, b) -> Column:
    return _zip(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.abs(x - y))


def negated_dot(a, b) -> Column:
    return -dot(a, b)


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean, "l2sq": squared_euclidean, "dot": negated_dot, "manhattan": manhattan}


def distance(metric: str, a, b) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}")
    return DISTANCES[metric](a, b)


def similarity(metric: str, a, b) -> Column:
    """Higher is better: cosine 1 - d, dot product as it is, otherwise 1 / (1 + d)."""
    if metric == "cosine":
        return cosine_similarity(a, b)
    if metric == "dot":
        return dot(a, b)
    return 1 / (1 + distance(metric, a, b))


def distance_to_score(metric: str, d: Column) -> Column:
    return 1 - d if metric == "cosine" else -d if metric == "dot" else 1 / (1 + d)


def normalize(a) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def add(a, b, wa: float = 1.0, wb: float = 1.0) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * wa + y.cast("double") * wb)


def hamming(a, b) -> Column:
    """Different bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


# ---------------------------------------------------------------- sparse vectors: MAP<key, double>
def sparse_dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    shared = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    return F.aggregate(shared, F.lit(0.0), lambda acc, k: acc + F.element_at(a, k).cast("double") * F.element_at(b, k).cast("double"))


def sparse_norm(a) -> Column:
    return norm(F.map_values(_c(a)))


def sparse_cosine(a, b) -> Column:
    scale = sparse_norm(a) * sparse_norm(b)
    return F.when(scale > 0, sparse_dot(a, b) / scale).otherwise(0.0)


def sparse_from_dense(v, least: float = 1e-6) -> Column:
    """Indices (from 0) and values of the components above least in size."""
    pairs = F.transform(_c(v), lambda x, i: F.struct(i.alias("key"), x.cast("double").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.abs(p["value"]) > least))


def sparse_to_dense(m, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(_c(m), i), F.lit(0.0)))


def sparse_top(m, k: int) -> Column:
    """The k entries of largest size, in order of their keys."""
    entries = F.transform(F.map_entries(_c(m)), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("key"), e["value"].alias("value")))
    best = F.slice(F.array_sort(entries), 1, k)
    return F.map_from_entries(F.array_sort(F.transform(best, lambda e: F.struct(e["key"], e["value"]))))


def sparse_normalize(m) -> Column:
    n = sparse_norm(m)
    return F.transform_values(_c(m), lambda _, v: F.when(n > 0, v / n).otherwise(v))


def tf_idf(tf, idf) -> Column:
    """(1 + ln tf) * idf of two maps by term, in unit length."""
    weights = F.transform_values(_c(tf), lambda t, n: (1 + F.log(n.cast("double"))) * F.coalesce(F.element_at(_c(idf), t), F.lit(1.0)))
    return sparse_normalize(weights)
