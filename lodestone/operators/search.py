"""Dense, sparse, keyword and late-interaction search over DataFrames of points.

Every top-k has a total order: score rounded to six digits, highest first, then id. Filters come before top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.functions.filters import compile_filter

DIGITS = 6
#: Rows of a block of queries and of points in a kNN join, on average at most.
QUERY_BLOCK = 2_000
POINT_BLOCK = 50_000
#: Scores that a kNN join holds at once in a task.
SCORES = 4_000_000


def rounded(score: Column) -> Column:
    return F.round(score, DIGITS)


def top(scored: DataFrame, k: int, id_col: str = "id", offset: int = 0, threshold: float | None = None) -> DataFrame:
    """The k best rows by (score, id), after offset ones; with rank from 1 within the page."""
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    page = scored.withColumn("score", rounded(F.col("score"))).orderBy(F.desc("score"), id_col)
    return (page.offset(offset) if offset else page).limit(k)


def top_per(scored: DataFrame, k: int, group: str | list[str], id_col: str = "id") -> DataFrame:
    """The k best rows of each group, with their rank."""
    by = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    return scored.withColumn("score", rounded(F.col("score"))).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _filtered(points: DataFrame, where, ids: DataFrame | None, id_col: str) -> DataFrame:
    if where is not None:
        points = points.where(where if isinstance(where, Column) else compile_filter(where, points.schema))
    return points.join(ids.select(id_col), id_col, "left_semi") if ids is not None else points


# ---------------------------------------------------------------- dense
def vector_search(points: DataFrame, query, k: int = 10, metric: str = "cosine", where=None, ids: DataFrame | None = None, threshold: float | None = None, offset: int = 0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact k nearest points of one query vector (a sequence of numbers)."""
    kept = _filtered(points, where, ids, id_col).where(F.size(vector_col) == len(query))
    return top(kept.withColumn("score", V.similarity(metric, vector_col, query)), k, id_col, offset, threshold)


def knn_join(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "qid", query_vector: str = "qvector") -> DataFrame:
    """The k nearest points of each query: query id, id, score, rank.

    Queries and points are dealt into blocks of at most QUERY_BLOCK and POINT_BLOCK rows on average; each pair of
    blocks is one task's work, which keeps its k best per query. Only counts come to the driver, and nothing is
    broadcast. Queries without a vector find nothing.
    """
    kind_q, kind_id = queries.schema[query_id].dataType.simpleString(), points.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    known = points.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    a, b = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (known, POINT_BLOCK)))

    def dealt(key: str, blocks: int, other: int, block: str, across: str) -> DataFrame:
        df = (asked if key == "q" else known).withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)))
        return df.withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))

    def best(part: pa.Table, rows: pa.Table) -> pa.Table:
        schema = pa.schema([pa.field("q", part.schema.field("q").type), pa.field("i", rows.schema.field("i").type), pa.field("score", pa.float64())])
        sizes = np.diff(np.asarray(part.column("v").combine_chunks().offsets)), np.diff(np.asarray(rows.column("v").combine_chunks().offsets))
        out = []
        for size in np.intersect1d(*sizes):  # vectors of another length share no score
            mine, theirs = (t.filter(pa.array(n == size)) for t, n in zip((part, rows), sizes))
            x, y = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, size) for t in (mine, theirs))
            ids = theirs.column("i").to_numpy()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            step = max(1, SCORES // len(x))
            for lo in range(0, len(y), step):
                held = [_keep([*held, (np.round(_scores(metric, x, y[lo : lo + step]), DIGITS), ids[lo : lo + step])], k)]
            for score, found in held:
                good = np.isfinite(score)
                out.append(pa.Table.from_arrays([mine.column("q").take(pa.array(np.repeat(np.arange(len(x)), good.sum(axis=1)))), pa.array(found[good], schema.field("i").type), pa.array(score[good])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    left = dealt("q", a, b, "qb", "pb").groupBy("qb", "pb")
    right = dealt("i", b, a, "pb", "qb").groupBy("qb", "pb")
    found = left.cogroup(right).applyInArrow(lambda x, y: best(x, y), f"q {kind_q}, i {kind_id}, score double")
    ranked = top_per(found.withColumnRenamed("i", id_col), k, "q", id_col)
    return ranked.select(F.col("q").alias(query_id), id_col, "score", "rank")


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "cosine":
        scale = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
        return np.divide(q @ x.T, scale, out=np.zeros((len(q), len(x))), where=scale > 0)
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        gap = x - row
        out[i] = np.abs(gap).sum(1) if metric == "manhattan" else (gap * gap).sum(1)
    return 1 / (1 + (np.sqrt(out) if metric == "euclidean" else out))


def _keep(held: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by (score, id)."""
    scores = np.concatenate([s for s, _ in held], axis=1)
    ids = np.concatenate([np.broadcast_to(i, (len(scores), len(i))) if i.ndim == 1 else i for _, i in held], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    order = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(scores, by_id, 1), axis=1, kind="stable"), 1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def with_negatives(positive, negatives: DataFrame, vector_col: str = "vector", weight: float = 0.5) -> list[float]:
    """normalize(positive - weight * mean of the negatives)."""
    means = negatives.select(F.posexplode(vector_col)).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m")).collect()
    v = np.array(positive, float)
    for r in means:
        v[r["pos"]] -= weight * r["m"]
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def multi_query(hits: DataFrame, k: int = 10, strategy: str = "max", weights: dict | None = None, id_col: str = "id", query_id: str = "qid") -> DataFrame:
    """Combine the hits of several queries per id: max, mean over the queries that found it, or weighted sum over
    all weights."""
    if strategy == "weighted":
        w = F.element_at(F.create_map(*[x for q, v in weights.items() for x in (F.lit(q), F.lit(float(v)))]), F.col(query_id))
        score = F.sum(F.col("score") * w) / float(sum(weights.values()))
    else:
        score = {"max": F.max, "mean": F.avg}[strategy]("score")
    return top(hits.groupBy(id_col).agg(score.alias("score")), k, id_col)


def similar_to(points: DataFrame, key, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest points of a stored point, itself left out."""
    row = points.where(F.col(id_col) == F.lit(key)).select(vector_col).head()
    if row is None:
        return points.limit(0).withColumn("score", F.lit(0.0))
    return vector_search(points.where(F.col(id_col) != F.lit(key)), list(row[0]), k, metric, id_col=id_col, vector_col=vector_col)


def prefetch_rescore(points: DataFrame, coarse: Column, exact: Column, k: int = 10, prefetch: int | None = None, id_col: str = "id") -> DataFrame:
    """The best 4k rows (or prefetch) by a cheap score, then the k best of those by an exact one."""
    return top(top(points.withColumn("score", coarse), prefetch or 4 * k, id_col).withColumn("score", exact), k, id_col)


def greedy_dedup(points: DataFrame, threshold: float = 0.95, block: str | None = None, order: str = "id", vector_col: str = "vector") -> DataFrame:
    """In order, keep a row unless it is as similar as threshold to one kept before it in its block."""
    schema = points.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = np.stack(pdf[vector_col].to_numpy()).astype(float)
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
        kept: list[int] = []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() < threshold:
                kept.append(i)
        return pdf.iloc[kept]

    blocked = points.withColumn("__b", F.col(block) if block else F.lit(0))
    return blocked.groupBy("__b").applyInPandas(lambda pdf: run(pdf.drop(columns="__b")), schema)


# ---------------------------------------------------------------- late interaction
def maxsim(docs: DataFrame, query: DataFrame, k: int | None = 10, id_col: str = "id", cosine: bool = True) -> DataFrame:
    """Sum over query tokens of the greatest similarity of a document token; k None: of all documents. docs: (id, pos,
    vec); query: (qpos, qvec), the tokens of one query against all rows."""
    score = V.cosine_similarity("qvec", "vec") if cosine else V.dot("qvec", "vec")
    pairs = docs.crossJoin(query).groupBy(id_col, "qpos").agg(F.max(score).alias("s"))
    summed = pairs.groupBy(id_col).agg(F.sum("s").alias("score"))
    return summed.withColumn("score", rounded(F.col("score"))) if k is None else top(summed, k, id_col)


def token_matches(docs: DataFrame, query: DataFrame, threshold: float, id_col: str = "id") -> DataFrame:
    """(id, qpos, pos, score) of token pairs at least as similar as threshold."""
    pairs = docs.crossJoin(query).withColumn("score", rounded(V.cosine_similarity("qvec", "vec")))
    return pairs.where(F.col("score") >= threshold).select(id_col, "qpos", "pos", "score")


def centroids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Normalised mean of each document's normalised token vectors: (id, centroid)."""
    parts = docs.select(id_col, F.posexplode(V.normalize("vec")).alias("i", "x")).groupBy(id_col, "i").agg(F.avg("x").alias("x"))
    gathered = parts.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return gathered.select(id_col, V.normalize("c").alias("centroid"))


# ---------------------------------------------------------------- sparse
def postings(points: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    return points.select(id_col, F.explode(sparse_col).alias("key", "value"))


def sparse_search(entries: DataFrame, query: dict, k: int = 10, threshold: float | None = None, cosine: bool = False, id_col: str = "id") -> DataFrame:
    """Sparse dot (or cosine) product over postings (id, key, value), with the number of matched keys, in one pass."""
    spark = entries.sparkSession
    kind = entries.schema["key"].dataType.simpleString()
    q = F.broadcast(spark.createDataFrame([(key, float(v)) for key, v in query.items()], f"key {kind}, q double"))
    if not cosine:
        return top(entries.join(q, "key").groupBy(id_col).agg(F.sum(F.col("value") * F.col("q")).alias("score"), F.count("*").alias("matched")), k, id_col, threshold=threshold)
    scale = float(np.sqrt(sum(v * v for v in query.values())))
    length = F.sqrt(F.sum(F.col("value") * F.col("value"))) * scale
    both = entries.join(q, "key", "left").groupBy(id_col).agg(F.sum(F.col("value") * F.col("q")).alias("score"), F.count("q").alias("matched"), length.alias("n")).where("matched > 0")
    return top(both.withColumn("score", F.when(F.col("n") > 0, F.col("score") / F.col("n")).otherwise(0.0)).drop("n"), k, id_col, threshold=threshold)


# ---------------------------------------------------------------- keyword
#: Inverse document frequency of N documents and df documents with the term.
IDF: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda n, df: F.log((n + 1) / (df + 0.5)),
    "classic": lambda n, df: F.log((n - df + 0.5) / (df + 0.5) + 1),
}


@dataclass(frozen=True)
class Tokens:
    """Which tokens count: their least length and the words left out."""

    least: int = 3
    stopwords: tuple[str, ...] = tuple(X.STOPWORDS)

    def rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term): a row for each token, or one without a term for a text that has none. Splitting makes rows at
        once, so that all conditions are compiled instead of run over arrays."""
        parts = docs.select(F.col(id_col), F.explode_outer(F.split(F.lower(text_col), r"[^\p{L}\p{N}_]+")).alias("t"))
        good = (F.length("t") >= self.least) & F.col("t").rlike("^[a-z0-9]+$")
        if self.stopwords:
            good &= ~F.col("t").isin(*self.stopwords)
        return parts.select(id_col, F.when(good, F.col("t")).alias("term"))


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokens: Tokens = Tokens(), stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) and (id, len). Stems are made per distinct term and joined back."""
    each = tokens.rows(docs, id_col, text_col)
    lengths = each.groupBy(id_col).agg(F.count("term").alias("len"))
    tf = each.where("term is not null").groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    if stem:
        stems = X.stem_terms(tf)
        tf = tf.join(stems, "term").groupBy(id_col, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return tf, lengths


def bm25(docs: DataFrame, query: list[str], k: int | None = 10, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, idf: str = "plus", delta: float = 0.0, repeats: bool = False, tokens: Tokens = Tokens(), stem: bool = False, within: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """BM25 scores of documents that hold a query term: id, score, matched.

    One pass over the texts counts each document's tokens and its occurrences of the query's terms. The number of
    documents, their mean length and document frequencies are those of all docs, whatever within restricts. delta
    above 0 is BM25+; with repeats a term counts as often as the query has it.
    """
    words = [t.lower() for t in query]
    if stem:
        words = [*words, *(X.porter(w) for w in words)]
    times = {w: words.count(w) if repeats else 1 for w in words}
    names = {w: f"tf{i}" for i, w in enumerate(times)}
    rows = tokens.rows(docs, id_col, text_col)
    if stem:
        rows = rows.join(X.stem_terms(rows.where("term is not null")), "term", "left").select(id_col, F.coalesce("stem", "term").alias("term"))
    counted = rows.groupBy(id_col).agg(F.count("term").alias("len"), *[F.count_if(F.col("term") == w).alias(c) for w, c in names.items()])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in names.values()])
    if within is not None:
        counted = counted.join(within.select(id_col), id_col, "left_semi")
    any_hit, score, matched = F.lit(False), F.lit(0.0), F.lit(0)
    for w, c in names.items():
        tf, hit = F.col(c), F.col(c) > 0
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean"))) + delta
        score = score + F.when(hit, times[w] * IDF[idf](F.col("n"), F.col(f"d{c}")) * part).otherwise(0.0)
        matched = matched + hit.cast("int")
        any_hit |= hit
    out = counted.where(any_hit).crossJoin(F.broadcast(stats)).select(id_col, score.alias("score"), matched.cast("long").alias("matched"))
    if k is None:
        return out.withColumn("score", rounded(F.col("score")))
    return top(out, k, id_col, threshold=threshold)


def bm25_weights(docs: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, sparse): BM25 weights of each document as a map by term."""
    tf, lengths = term_counts(docs, id_col, text_col, Tokens(2, ()))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(df, "term").join(lengths, id_col).crossJoin(F.broadcast(stats))
    weight = IDF["plus"](F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", rounded(weight).alias("w"))))).alias("sparse"))


def expand_query(terms: list[str], synonyms: dict[str, list[str]] | None = None, learned: dict[str, dict[str, float]] | None = None, most: int = 3) -> dict[str, float]:
    """Weights of a query's terms and of up to `most` expansions each: synonyms at 0.7 first, then learned ones."""
    out = {t: 1.0 for t in terms}
    for t in terms:
        more = [(s, 0.7) for s in (synonyms or {}).get(t, [])] + list((learned or {}).get(t, {}).items())
        for s, w in more[:most]:
            out[s] = max(out.get(s, 0.0), w)
    return out
