"""Facets, statistics, retrieval metrics, latency figures and composed searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.filters import acl_predicate
from lodestone.operators.graph import persist
from lodestone.operators.search import rounded, vector_search


def facet(df: DataFrame, field: str, limit: int = 10, min_count: int = 1, by_value: bool = False) -> DataFrame:
    """Counts of a field's values: value, n, total, other (counts beyond the limit). Nulls are left out, lists count
    each element; ties go to the smaller value."""
    kind = df.schema[field].dataType
    values = df.select(F.explode(field).alias("value")) if isinstance(kind, T.ArrayType) else df.select(F.col(field).alias("value"))
    counts = values.where(F.col("value").isNotNull()).groupBy(F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    total = counts.agg(F.sum("n").alias("total"))
    page = counts.orderBy("value") if by_value else counts.orderBy(F.desc("n"), "value")
    shown = page.limit(limit)
    told = shown.agg(F.sum("n").alias("shown"))
    return shown.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(told)).select("value", "n", "total", (F.col("total") - F.col("shown")).alias("other"))


def facets(df: DataFrame, fields: list[str], limit: int = 10) -> DataFrame:
    """facet() of several fields: field, value, n, total, other."""
    out = None
    for name in fields:
        part = facet(df, name, limit).select(F.lit(name).alias("field"), "value", "n", "total", "other")
        out = part if out is None else out.unionByName(part)
    return out


def search_with_facets(points: DataFrame, query, fields: list[str], k: int = 10, where=None, pool: int = 100, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k best hits, and facets over the best max(k, pool)."""
    wide = vector_search(points, query, max(k, pool), where=where)
    return wide.orderBy(F.desc("score"), "id").limit(k), facets(wide, fields, limit)


def search_with_acl(points: DataFrame, query, principals: list[str], k: int = 10, where=None, acl_col: str = "_acl", default_allow: bool = False) -> DataFrame:
    """The k best hits among the rows that principals may read."""
    return vector_search(points.where(acl_predicate(F.col(acl_col), principals, default_allow)), query, k, where=where)


def field_stats(df: DataFrame, field: str) -> DataFrame:
    """n, low, high, n_unique of a scalar field; for lists also the mean number of elements."""
    f = F.col(field)
    if isinstance(df.schema[field].dataType, T.ArrayType):
        per = df.agg(F.count(f).alias("n"), rounded(F.avg(F.size(f))).alias("mean_size"))
        return per.crossJoin(F.broadcast(df.select(F.explode(f).alias("v")).agg(F.countDistinct("v").alias("n_unique"))))
    return df.agg(F.count(f).alias("n"), F.min(f).alias("low"), F.max(f).alias("high"), F.countDistinct(f).alias("n_unique"))


# ---------------------------------------------------------------- retrieval metrics
def retrieval_metrics(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: recall, reciprocal rank of the first hit, and nDCG at k. results: (qid, id, rank); truth: (qid, id)."""
    judged = results.where(F.col("rank") <= k).join(truth.select("qid", "id", F.lit(True).alias("hit")).distinct(), ["qid", "id"], "left")
    return graded(judged.withColumn("hit", F.col("hit").isNotNull()), truth.groupBy("qid").agg(F.countDistinct("id").alias("relevant")), k)


def graded(judged: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """retrieval_metrics() of judged results (qid, rank, hit) and numbers of relevant ids (qid, relevant): where relevance
    follows from the rows themselves, no table of relevant pairs is needed."""
    hit = F.col("hit")
    gained = judged.where(F.col("rank") <= k).groupBy("qid").agg(
        F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    joined = relevant.join(gained, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return joined.select(
        "qid", rounded(F.coalesce(F.col("hits"), F.lit(0)) / F.col("relevant")).alias("recall"), rounded(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        rounded(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
    )


# ---------------------------------------------------------------- latency
def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Values at index int(n * share) of the sorted values, as p50, p95, ...

    Values are dealt by ranges and kept; counts of the ranges say in which one each index falls, and only those
    are numbered. An empty column gives nulls.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = persist(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).repartitionByRange(ranges, "v").withColumn("p", F.spark_partition_id()))
    counts = {r["p"]: r["n"] for r in dealt.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row a range
    total, before, at = sum(counts.values()), 0, {}
    for p in sorted(counts):
        for s in shares:
            i = min(int(total * s), total - 1)
            if before <= i < before + counts[p]:
                at[s] = (p, i - before + 1)
        before += counts[p]
    numbered = dealt.where(F.col("p").isin([p for p, _ in at.values()])).withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("v")))
    return numbered.agg(*[F.max(F.when((F.col("p") == at.get(s, (-1, 0))[0]) & (F.col("i") == at.get(s, (-1, 0))[1]), F.col("v"))).alias(f"p{round(100 * s)}") for s in shares])


def latency_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, deviation, extremes and interpolated percentiles."""
    v = F.col(value)
    figures = [F.count(v).alias("n"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_pop(v)).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")]
    figures += [rounded(F.percentile(v, F.lit(s))).alias(f"p{round(100 * s)}") for s in (0.5, 0.95, 0.99)]
    return df.groupBy(*(by or [])).agg(*figures)


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal widths between the extremes; the last bin is closed."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def compare_runs(before: DataFrame, after: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(name, change, verdict) of two benchmark runs (name, value): percent change; higher is better."""
    joined = before.select("name", F.col("value").alias("a")).join(after.select("name", F.col("value").alias("b")), "name", "full_outer")
    change = rounded(F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100))
    verdict = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("change") > tolerance, "improved").when(F.col("change") < -tolerance, "regressed").otherwise("unchanged")
    return joined.withColumn("change", change).select("name", "change", verdict.alias("verdict"))


def sync_status(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, source, target, pending) row counts of collections (name) on both sides."""
    a = source.groupBy("name").agg(F.count("*").alias("source"))
    b = target.groupBy("name").agg(F.count("*").alias("target"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "name", "full_outer").select("name", zero("source").alias("source"), zero("target").alias("target"), F.greatest(F.lit(0), zero("source") - zero("target")).alias("pending"))


def redact_id(key: Column) -> Column:
    """Ids of more than eight characters as first four, ***, last four."""
    s = key.cast("string")
    return F.when(F.length(s) > 8, F.concat(F.substring(s, 1, 4), F.lit("***"), F.substring(s, -4, 4))).otherwise(s)
