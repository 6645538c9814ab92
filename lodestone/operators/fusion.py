"""Rank fusion and re-ranking of result lists (source, id, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators.search import rounded, top


def sources(**lists: DataFrame) -> DataFrame:
    """One frame (source, id, score) of several result lists with columns id and score."""
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("source"), "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def ranked(lists: DataFrame) -> DataFrame:
    """lists with the rank of each row in its source, from 1; ties by id."""
    by = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    return lists.withColumn("score", rounded(F.col("score"))).withColumn("rank", F.row_number().over(by))


def _weight(weights: dict[str, float] | None):
    if not weights:
        return F.lit(1.0)
    pairs = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
    return F.coalesce(F.element_at(pairs, F.col("source")), F.lit(1.0))


def rrf(lists: DataFrame, k: int = 10, constant: int = 60, weights: dict[str, float] | None = None, boost: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (constant + rank); ids that several sources found times boost."""
    part = _weight(weights) / (constant + F.col("rank"))
    fused = ranked(lists).groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("n_sources"))
    return top(fused.withColumn("score", F.when(F.col("n_sources") > 1, F.col("score") * boost).otherwise(F.col("score"))), k)


def explain_sources(lists: DataFrame) -> DataFrame:
    """(id, sources): score and rank that each source gave."""
    entries = F.array_sort(F.collect_list(F.struct("source", F.struct("score", "rank").alias("v"))))
    return ranked(lists).groupBy("id").agg(F.map_from_entries(entries).alias("sources"))


def linear(lists: DataFrame, k: int = 10, method: str = "minmax", weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of normalised scores; weights are renormalised over the sources that have rows."""
    all_of = Window.partitionBy("source")
    s = F.col("score")
    low, high = F.min(s).over(all_of), F.max(s).over(all_of)
    spread = F.stddev_pop(s).over(all_of)
    norm = {
        "minmax": F.when(high > low, (s - low) / (high - low)).otherwise(1.0),
        "zscore": F.when(spread > 0, (s - F.avg(s).over(all_of)) / spread).otherwise(0.0),
        "rank": 1 - (F.col("rank") - 1) / F.count("*").over(all_of),
        "none": s,
    }[method]
    frame = ranked(lists).withColumn("norm", norm).withColumn("w", _weight(weights))
    total = frame.select("source", "w").distinct().agg(F.sum("w").alias("total"))
    return top(frame.crossJoin(F.broadcast(total)).groupBy("id").agg(F.sum(F.col("norm") * F.col("w") / F.col("total")).alias("score")), k)


def condorcet(lists: DataFrame, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted pairwise wins less losses of each candidate; a list's missing ids rank last.

    In one source, a present id beats those ranked behind it and all absent ones, so wins and losses follow from
    the rank and the list sizes: no pairs of candidates are made.
    """
    sized = ranked(lists).withColumn("w", _weight(weights)).withColumn("size", F.count("*").over(Window.partitionBy("source")))
    # present: wins n - rank, losses rank - 1; absent: losses size. Lists are short, so windows over all rows do
    each = sized.groupBy("id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * (1 - 2 * F.col("rank") + F.col("size"))).alias("s"), F.sum(F.when(F.col("rank") == 1, F.col("w") * F.col("size")).otherwise(0.0)).alias("first"))
    everything = Window.partitionBy(F.lit(0))
    n, absent = F.count("*").over(everything), F.sum("first").over(everything)
    return top(each.select("id", (F.col("s") + F.col("w") * n - absent).alias("score")), k)


def hybrid(dense: DataFrame, other: DataFrame, k: int = 10, dense_weight: float = 0.5, other_weight: float = 0.5, constant: int = 60, boost: float = 1.1) -> DataFrame:
    """Weighted rank fusion of dense hits with keyword or sparse hits; weights are scaled to 1."""
    total = dense_weight + other_weight
    return rrf(sources(dense=dense, other=other), k, constant, {"dense": dense_weight / total, "other": other_weight / total}, boost)


def blend_max(hits: DataFrame, late: DataFrame, k: int = 10, hit_weight: float = 0.6, late_weight: float = 0.4) -> DataFrame:
    """Fused score and late-interaction score over its maximum: hit_weight and late_weight parts."""
    joined = hits.select("id", F.col("score").alias("a")).join(late.select("id", F.col("score").alias("b")), "id", "left")
    peak = F.greatest(F.max("b").over(Window.partitionBy(F.lit(0))), F.lit(1e-6))  # of the few hits
    return top(joined.withColumn("peak", peak).withColumn("score", hit_weight * F.col("a") + late_weight * F.coalesce(F.col("b"), F.lit(0.0)) / F.col("peak")), k).select("id", "score")


def dense_sparse_late(dense: DataFrame, sparse: DataFrame, late: DataFrame, k: int = 10, boost: float = 1.15) -> DataFrame:
    """0.35 dense + 0.35 sparse + 0.3 late interaction of normalised scores, or halves without late hits; times
    boost where dense and sparse agree."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("peak", F.max("score").over(Window.partitionBy(F.lit(0)))).select("id", F.when(F.col("peak") > 0, F.col("score") / F.col("peak")).otherwise(0.0).alias(name))

    joined = scaled(dense, "d").join(scaled(sparse, "s"), "id", "full_outer").join(scaled(late, "c"), "id", "left")
    d, s, c = (F.coalesce(F.col(x), F.lit(0.0)) for x in "dsc")
    score = F.when(c > 0, 0.35 * d + 0.35 * s + 0.3 * c).otherwise(0.5 * d + 0.5 * s)
    return top(joined.withColumn("score", F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), score * boost).otherwise(score)), k).select("id", "score")


# ---------------------------------------------------------------- re-ranking
def rerank_exact(hits: DataFrame, points: DataFrame, query, k: int = 10, vector_col: str = "vector") -> DataFrame:
    """Cosine of the stored vector instead of the hit's score; hits without a vector keep theirs."""
    joined = hits.select("id", F.col("score").alias("original_score")).join(points.select("id", F.col(vector_col).alias("__v")), "id", "left")
    score = F.when(F.col("__v").isNull(), F.col("original_score")).otherwise(V.cosine_similarity("__v", query))
    return top(joined.withColumn("score", score), k).drop("__v")


def rerank_weighted(hits: DataFrame, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of {key}_score columns, missing ones 0; the vector part falls back to score."""
    weights = weights or {"vector": 0.7, "text": 0.2, "recency": 0.1}
    out = F.lit(0.0)
    for key, w in weights.items():
        name = f"{key}_score"
        part = F.col(name) if name in hits.columns else F.lit(None).cast("double")
        part = F.coalesce(part, F.col("score")) if key == "vector" else F.coalesce(part, F.lit(0.0))
        out = out + w * part
    return top(hits.withColumn("score", out), k)


def mmr(hits: DataFrame, points: DataFrame, k: int = 10, trade: float = 0.5, candidates: int = 100, group: str | None = None, clamp: bool = True, vector_col: str = "vector") -> DataFrame:
    """Maximal marginal relevance: greedily trade * relevance - (1 - trade) * similarity to what is selected.

    At most `candidates` hits of each group take part; score stays the relevance, mmr_rank is the order.
    """
    key = group or "__g"
    frame = hits if group else hits.withColumn(key, F.lit(0))
    by = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    chosen = frame.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= candidates).select(key, "id", "score")
    joined = chosen.join(points.select("id", F.col(vector_col).alias("__v")), "id")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x = np.stack(pdf["__v"].to_numpy()).astype(float)
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
        rel, nearest, picked = pdf["score"].to_numpy(), np.full(len(x), 0.0 if clamp else -np.inf), []
        free = np.ones(len(x), bool)
        while len(picked) < min(k, len(x)):
            gain = trade * rel - (1 - trade) * np.where(np.isfinite(nearest), nearest, 0.0)
            i = int(np.where(free, gain, -np.inf).argmax())
            picked.append(i)
            free[i] = False
            nearest = np.maximum(nearest, x @ x[i])
        return pdf.iloc[picked][[key, "id", "score"]].assign(mmr_rank=range(1, len(picked) + 1))

    out = joined.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, id {kinds['id']}, score double, mmr_rank int")
    return out if group else out.drop(key)


def rerank_model(hits: DataFrame, texts: DataFrame, query: str, score_pairs, k: int = 10) -> DataFrame:
    """Scores of a given function (query, list of texts) -> list of floats; hits without a text are dropped."""

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(score_pairs(query, t.tolist()), dtype=float)

    joined = hits.select("id", F.col("score").alias("original_score")).join(texts.select("id", "text"), "id").where(F.col("text").isNotNull())
    return top(joined.withColumn("score", run("text")), k).drop("text")
