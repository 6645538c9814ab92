"""Every registered query of the retrieval engine, with its DuckDB oracle where SQL can express it.

A query takes (spark, sf_dir) and reads the tables it needs whole. Points are the embeddings, paired with the
documents of the same number where a query needs texts or tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.functions.filters import acl_predicate, compile_filter, geo_box, geo_radius, geohash, haversine_km
from lodestone.operators import aggregates as A
from lodestone.operators import collection as C
from lodestone.operators import documents as D
from lodestone.operators import facade as E
from lodestone.operators import fusion as U
from lodestone.operators import graph as G
from lodestone.operators import quantize as Q
from lodestone.operators import search as S
from lodestone.streaming import ingest as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).join(texts(spark, sf_dir), "id")


def vector_of(spark: SparkSession, sf_dir: str, key: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == key).select("embedding").head()[0])


# ---------------------------------------------------------------- SQL pieces
V_SQL = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
Q_SQL = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def tokens_sql(col: str, least: int = 1, stop: bool = False) -> str:
    cond = "regexp_full_match(t, '[a-z0-9]+')" + (f" AND length(t) >= {least}" if least > 1 else "") + (f" AND t NOT IN ({STOP_SQL})" if stop else "")
    return f"list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: {cond})"


def bm25_sql(terms: list[str], idf: str, k1: float, b: float, delta: float = 0.0, where: str = "true", tokens: str | None = None) -> str:
    """CTEs ending in bm(id, score, matched) over all documents."""
    words = ", ".join(f"('{t}')" for t in terms)
    toks = tokens or tokens_sql("text", 3, True)
    return f"""
d AS (SELECT doc_id AS id, {toks} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
qt(term) AS (VALUES {words}),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT tf.id, round(sum({idf} * (tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / mean)) + {delta})), 6) AS score, count(*) AS matched
  FROM tf JOIN df USING (term), st WHERE tf.id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY tf.id)"""


PLUS, CLASSIC = "ln((n + 1) / (df + 0.5))", "ln((n - df + 0.5) / (df + 0.5) + 1)"
TERMS = ["tion", "erre", "inth", "haea"]
METRIC_SQL = {
    "cosine": "list_cosine_similarity(v, q)",
    "euclidean": "1 / (1 + sqrt(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))",
    "dot": "list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2]))",
    "manhattan": "1 / (1 + list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2]))))",
}

# ---------------------------------------------------------------- filters
_DOCS = "SELECT doc_id, n_chars FROM documents WHERE "
FILTERS: dict[str, tuple[object, str]] = {
    "eq": ({"lang": "en"}, "lang = 'en'"),
    "ne": ({"lang": {"$ne": "en"}}, "lang <> 'en'"),
    "compare": ({"n_chars": {"$gt": 500, "$lte": 2000}}, "n_chars > 500 AND n_chars <= 2000"),
    "in": ({"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')"),
    "nin": ({"lang": {"$nin": ["de", "fr"]}}, "lang NOT IN ('de', 'fr')"),
    "contains": ({"text": {"$contains": "tion"}}, "contains(text, 'tion')"),
    "icontains": ({"text": {"$icontains": "THE"}}, "contains(lower(text), 'the')"),
    "starts_ends": ({"$and": [{"source": {"$starts_with": "src"}}, {"source": {"$ends_with": "0"}}]}, "source LIKE 'src%' AND source LIKE '%0'"),
    "regex": ({"text": {"$regex": "th[ae]t?ion"}}, "regexp_matches(text, 'th[ae]t?ion')"),
    "exists": ({"$and": [{"lang": {"$exists": True}}, {"text": {"$is_empty": False}}, {"source": {"$is_null": False}}]}, "lang IS NOT NULL AND text IS NOT NULL AND text <> '' AND source IS NOT NULL"),
    "between": ({"n_chars": {"$between": [300, 900]}}, "n_chars BETWEEN 300 AND 900"),
    "or_not": ({"$or": [{"lang": "es"}, {"$not": {"n_chars": {"$lt": 3000}}}]}, "lang = 'es' OR NOT n_chars < 3000"),
    "field_op": ({"field": "n_chars", "op": "gte", "value": 1000}, "n_chars >= 1000"),
    "clauses": (
        {"must": [{"key": "n_chars", "range": {"gte": 200, "lt": 5000}}], "should": [{"key": "lang", "match": {"value": "en"}}, {"key": "lang", "match": {"any": ["fr"]}}], "must_not": [{"key": "source", "match": {"value": "src0"}}]},
        "n_chars >= 200 AND n_chars < 5000 AND (lang = 'en' OR lang IN ('fr')) AND NOT source = 'src0'",
    ),
}
for _name, (_spec, _sql) in FILTERS.items():
    register(f"filter_{_name}", _DOCS + _sql)(
        lambda spark, d, spec=_spec: (lambda docs: docs.where(compile_filter(spec, docs.schema)).select("doc_id", "n_chars"))(table(spark, d, "documents"))
    )


@register("filter_not_null_logic", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, false)")
def filter_not_null_logic(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.where(compile_filter({"$not": {"toxic": 1}}, docs.schema)).select("doc_id")


@register("filter_lists", "SELECT doc_id FROM (SELECT doc_id, [lang, source] AS tags FROM documents) WHERE list_has_any(tags, ['en', 'src1']) AND NOT list_has_all(tags, ['en', 'src0'])")
def filter_lists(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    spec = {"$and": [{"tags": {"$any": ["en", "src1"]}}, {"$not": {"tags": {"$all": ["en", "src0"]}}}]}
    return docs.where(compile_filter(spec, docs.schema)).select("doc_id")


@register("filter_nested_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50")
def filter_nested_path(spark, d):
    events = table(spark, d, "events").withColumn("meta", F.from_json("props", "k int"))
    return events.where(compile_filter({"meta.k": {"$gte": 50}}, events.schema)).select("event_id", F.col("meta.k").alias("k"))


@register("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'")
def filter_date_range(spark, d):
    orders = table(spark, d, "orders")
    return orders.where(compile_filter({"o_orderdate": {"$date_range": {"start": "1995-01-01", "end": "1996-06-30"}}}, orders.schema)).select("o_orderkey")


_GEO = "SELECT c_custkey, (c_custkey % 180) - 90.0 AS lat, (c_custkey * 7 % 360) - 180.0 AS lon FROM customer"
_HAVERSINE = "2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))"


def places(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.struct(((F.col("c_custkey") % 180) - 90.0).alias("lat"), ((F.col("c_custkey") * 7 % 360) - 180.0).alias("lon")).alias("at"))


@register(
    "filter_geo_radius",
    f"""SELECT c_custkey, round({_HAVERSINE}, 3) AS km FROM (SELECT c_custkey, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2) AS a FROM ({_GEO}))
    WHERE {_HAVERSINE} <= 3000""",
)
def filter_geo_radius(spark, d):
    kept = places(spark, d).where(geo_radius(F.col("at"), {"center": {"lat": 10, "lon": 20}, "radius_km": 3000}))
    return kept.select("c_custkey", F.round(haversine_km(F.col("at.lat"), F.col("at.lon"), 10, 20), 3).alias("km"))


@register("filter_geo_box", f"SELECT c_custkey FROM ({_GEO}) WHERE lat BETWEEN -20 AND 20 AND lon BETWEEN -50 AND 50")
def filter_geo_box(spark, d):
    return places(spark, d).where(geo_box(F.col("at"), {"min_lat": -20, "max_lat": 20, "min_lon": -50, "max_lon": 50})).select("c_custkey")


@register("geo_cells")
def geo_cells(spark, d):
    return places(spark, d).groupBy(geohash(F.col("at.lat"), F.col("at.lon"), 3).alias("cell")).agg(F.count("*").alias("n"))


@register("filter_ids", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q WHERE id IN (SELECT l_orderkey FROM lineitem) ORDER BY score DESC, id LIMIT 10")
def filter_ids(spark, d):
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 10, ids=ids).select("id", "score")


_ACL = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ['public'] WHEN doc_id % 5 = 0 THEN ['deny:user:ann', 'group:' || lang] WHEN doc_id % 3 = 0 THEN ['ann'] WHEN doc_id % 2 = 0 THEN ['group:' || lang] ELSE NULL END AS acl FROM documents"


def acl_documents(spark, d):
    k = F.col("doc_id")
    group = F.concat(F.lit("group:"), F.col("lang"))
    acl = F.when(k % 7 == 0, F.array(F.lit("public"))).when(k % 5 == 0, F.array(F.lit("deny:user:ann"), group)).when(k % 3 == 0, F.array(F.lit("ann"))).when(k % 2 == 0, F.array(group))
    return table(spark, d, "documents").withColumn("acl", acl)


@register("acl_check", f"SELECT doc_id FROM ({_ACL}) WHERE list_contains(acl, 'public') OR (NOT list_contains(acl, 'deny:user:ann') AND (list_contains(acl, 'ann') OR list_contains(acl, 'group:en')))")
def acl_check(spark, d):
    return acl_documents(spark, d).where(acl_predicate(F.col("acl"), ["user:ann", "group:en"])).select("doc_id")


# ---------------------------------------------------------------- dense search
for _metric, _expr in METRIC_SQL.items():
    register(f"knn_{_metric}", f"WITH {V_SQL}, {Q_SQL} SELECT id, round({_expr}, 6) AS score FROM v, q WHERE id <> 0 ORDER BY score DESC, id LIMIT 10")(
        lambda spark, d, m=_metric: S.vector_search(vectors(spark, d).where("id <> 0"), vector_of(spark, d, 0), 10, m).select("id", "score")
    )


@register("knn_filtered_threshold", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q WHERE label IN (1, 2, 3) AND list_cosine_similarity(v, q) >= 0.1 ORDER BY score DESC, id LIMIT 20")
def knn_filtered_threshold(spark, d):
    return S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 20, where={"label": {"$in": [1, 2, 3]}}, threshold=0.1).select("id", "score")


@register("knn_offset", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 10 OFFSET 5")
def knn_offset(spark, d):
    return S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 10, offset=5).select("id", "score")


_JOIN = f"""WITH {V_SQL}, s AS (SELECT a.id AS qid, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


@register("knn_join", _JOIN + " SELECT qid, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def knn_join(spark, d):
    p = vectors(spark, d)
    return S.knn_join(p, p.select(F.col("id").alias("qid"), F.col("vector").alias("qvector")), 5)


@register("multi_query_max", _JOIN + " SELECT id, max(score) AS score FROM r WHERE rank <= 20 GROUP BY id ORDER BY score DESC, id LIMIT 10")
def multi_query_max(spark, d):
    p = vectors(spark, d)
    hits = S.knn_join(p, p.select(F.col("id").alias("qid"), F.col("vector").alias("qvector")), 20)
    return S.multi_query(hits, 10, "max")


@register("multi_query_mean", _JOIN + " SELECT id, round(avg(score), 6) AS score FROM r WHERE rank <= 20 GROUP BY id ORDER BY score DESC, id LIMIT 10")
def multi_query_mean(spark, d):
    p = vectors(spark, d)
    hits = S.knn_join(p, p.select(F.col("id").alias("qid"), F.col("vector").alias("qvector")), 20)
    return S.multi_query(hits, 10, "mean")


@register(
    "knn_negatives",
    f"""WITH {V_SQL}, {Q_SQL}, m AS (SELECT i, avg(v[i]) AS m FROM v, range(1, 65) t(i) WHERE id IN (1, 2, 3) GROUP BY i),
    n AS (SELECT list(q[i] - 0.5 * m ORDER BY i) AS n FROM m, q)
    SELECT id, round(list_cosine_similarity(v, n), 6) AS score FROM v, n ORDER BY score DESC, id LIMIT 10""",
)
def knn_negatives(spark, d):
    p = vectors(spark, d)
    return S.vector_search(p, S.with_negatives(vector_of(spark, d, 0), p.where("id IN (1, 2, 3)")), 10).select("id", "score")


@register("similar_to_id", f"WITH {V_SQL}, q AS (SELECT v AS q FROM v WHERE id = 7) SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q WHERE id <> 7 ORDER BY score DESC, id LIMIT 5")
def similar_to_id(spark, d):
    return S.similar_to(vectors(spark, d), 7, 5).select("id", "score")


@register("normalize", f"WITH {V_SQL} SELECT id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS s FROM v")
def normalize(spark, d):
    return vectors(spark, d).select("id", F.round(F.aggregate(V.normalize("vector"), F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@register("prefetch_rescore", f"WITH {V_SQL}, {Q_SQL}, c AS (SELECT id, v, q FROM v, q ORDER BY round(list_inner_product(v[1:8], q[1:8]), 6) DESC, id LIMIT 40) SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM c ORDER BY score DESC, id LIMIT 10")
def prefetch_rescore(spark, d):
    q = vector_of(spark, d, 0)
    return S.prefetch_rescore(vectors(spark, d), V.dot(F.slice("vector", 1, 8), q[:8]), V.cosine_similarity("vector", q), 10).select("id", "score")


@register("dedup_greedy")
def dedup_greedy(spark, d):
    return S.greedy_dedup(vectors(spark, d), 0.95, "label").select("id", "label")


# ---------------------------------------------------------------- late interaction: four tokens of 16 dimensions
_TOK = "tok AS (SELECT id, i AS pos, v[16 * i + 1 : 16 * i + 16] AS vec FROM v, range(0, 4) t(i))"


def token_vectors(spark, d):
    return vectors(spark, d).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vector", i * 16 + 1, F.lit(16)))).alias("pos", "vec"))


@register("maxsim", f"WITH {V_SQL}, {_TOK}, m AS (SELECT b.id, a.pos, max(list_cosine_similarity(a.vec, b.vec)) AS s FROM tok a, tok b WHERE a.id = 0 GROUP BY ALL) SELECT id, round(sum(s), 6) AS score FROM m GROUP BY id ORDER BY score DESC, id LIMIT 10")
def maxsim(spark, d):
    t = token_vectors(spark, d)
    return S.maxsim(t, t.where("id = 0").select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec")), 10)


@register("token_matches", f"WITH {V_SQL}, {_TOK} SELECT b.id, a.pos AS qpos, b.pos AS pos, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM tok a, tok b WHERE a.id = 0 AND round(list_cosine_similarity(a.vec, b.vec), 6) >= 0.6")
def token_matches(spark, d):
    t = token_vectors(spark, d)
    return S.token_matches(t, t.where("id = 0").select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec")), 0.6).select("id", F.col("qpos").cast("long"), F.col("pos").cast("long"), "score")


@register("centroids")
def centroids(spark, d):
    return S.centroids(token_vectors(spark, d)).select("id", F.round(V.norm("centroid"), 6).alias("n"))


# ---------------------------------------------------------------- keyword search
_TOPK = " SELECT id, score, matched FROM bm ORDER BY score DESC, id LIMIT 20"


@register("bm25_keyword", "WITH " + bm25_sql(TERMS, PLUS, 1.2, 0.75) + _TOPK)
def bm25_keyword(spark, d):
    return S.bm25(texts(spark, d), TERMS, 20)


@register("bm25_filtered_global_stats", "WITH " + bm25_sql(TERMS, PLUS, 1.2, 0.75, where="lang = 'en' AND n_chars > 800") + _TOPK)
def bm25_filtered_global_stats(spark, d):
    docs = texts(spark, d)
    return S.bm25(docs, TERMS, 20, within=docs.where(compile_filter({"lang": "en", "n_chars": {"$gt": 800}}, docs.schema)))


@register("bm25_classic", "WITH " + bm25_sql(TERMS, CLASSIC, 1.5, 0.75, tokens=tokens_sql("text")) + _TOPK)
def bm25_classic(spark, d):
    return S.bm25(texts(spark, d), TERMS, 20, k1=1.5, idf="classic", tokens=S.Tokens(1, ()))


@register("bm25_plus", "WITH " + bm25_sql(TERMS, PLUS, 1.2, 0.75, 1.0) + _TOPK)
def bm25_plus(spark, d):
    return S.bm25(texts(spark, d), TERMS, 20, delta=1.0)


@register("bm25_all_scores", "WITH " + bm25_sql(TERMS, PLUS, 1.2, 0.75) + " SELECT id, score, matched FROM bm")
def bm25_all_scores(spark, d):
    return S.bm25(texts(spark, d), TERMS, None)


@register("bm25_stemmed")
def bm25_stemmed(spark, d):
    return S.bm25(texts(spark, d), TERMS, 20, stem=True)


@register("token_counts_per_document", f"SELECT doc_id, len({tokens_sql('text')}) AS n FROM documents")
def token_counts_per_document(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"))


@register("document_frequency", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text', 3, True)}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def document_frequency(spark, d):
    tf, _ = S.term_counts(texts(spark, d))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@register("stems")
def stems(spark, d):
    tf, _ = S.term_counts(texts(spark, d))
    return X.stem_terms(tf)


@register("text_ids", "SELECT doc_id, substr(md5(text), 1, 12) AS key FROM documents")
def text_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_id(F.col("text")).alias("key"))


@register("highlights")
def highlights(spark, d):
    return texts(spark, d).select("id", X.highlights(F.col("text"), TERMS).alias("parts")).where(F.size("parts") > 0)


@register("char_ngrams", "SELECT g, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(range(1, length(w)), lambda i: '#' || substr(w, CAST(i AS BIGINT), 2) || '#'), list_transform(range(1, length(w) - 1), lambda i: '#' || substr(w, CAST(i AS BIGINT), 3) || '#'))) AS g FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 0)) AS w FROM documents)) GROUP BY g")
def char_ngrams(spark, d):
    return table(spark, d, "documents").select(F.explode(X.char_ngrams(F.col("text"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@register("summaries")
def summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@register("chunks")
def chunks(spark, d):
    return X.chunk(table(spark, d, "documents"), "doc_id", "text", "recursive", 1000, 200)


@register("chunks_sentences")
def chunks_sentences(spark, d):
    return X.chunk(table(spark, d, "documents"), "doc_id", "text", "sentence", 1000, 50)


# ---------------------------------------------------------------- sparse search: term maps of documents
_SPARSE = f"p AS (SELECT doc_id AS id, term AS key, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest({tokens_sql('text', 3, True)}) AS term FROM documents) GROUP BY ALL)"
SPARSE_QUERY = {"tion": 1.0, "erre": 2.0, "inth": 0.5}
_SQ = "q(key, w) AS (VALUES ('tion', 1.0::DOUBLE), ('erre', 2.0::DOUBLE), ('inth', 0.5::DOUBLE))"


def term_postings(spark, d):
    tf, _ = S.term_counts(texts(spark, d))
    return tf.select("id", F.col("term").alias("key"), F.col("tf").cast("double").alias("value"))


@register("sparse_dot", f"WITH {_SPARSE}, {_SQ} SELECT id, round(sum(value * w), 6) AS score, count(*) AS matched FROM p JOIN q USING (key) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def sparse_dot(spark, d):
    return S.sparse_search(term_postings(spark, d), SPARSE_QUERY, 20)


@register("sparse_cosine", f"WITH {_SPARSE}, {_SQ}, n AS (SELECT id, sqrt(sum(value * value)) AS n FROM p GROUP BY id) SELECT id, round(sum(value * w) / (any_value(n) * sqrt(5.25)), 6) AS score, count(*) AS matched FROM p JOIN q USING (key) JOIN n USING (id) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def sparse_cosine(spark, d):
    return S.sparse_search(term_postings(spark, d), SPARSE_QUERY, 20, cosine=True)


@register("sparse_stats", f"WITH {_SPARSE} SELECT count(*) AS nnz, count(DISTINCT key) AS dims, count(DISTINCT id) AS docs FROM p")
def sparse_stats(spark, d):
    return term_postings(spark, d).agg(F.count("*").alias("nnz"), F.countDistinct("key").alias("dims"), F.countDistinct("id").alias("docs"))


@register("sparse_from_dense", f"WITH {V_SQL} SELECT id, len(list_filter(v, lambda x: abs(x) > 0.1)) AS n, round(sqrt(list_sum(list_transform(list_filter(v, lambda x: abs(x) > 0.1), lambda x: x * x))), 6) AS norm FROM v")
def sparse_from_dense(spark, d):
    m = vectors(spark, d).select("id", V.sparse_from_dense("vector", 0.1).alias("m"))
    return m.select("id", F.size("m").cast("long").alias("n"), F.round(V.sparse_norm("m"), 6).alias("norm"))


@register("bm25_sparse_vectors", f"""WITH d AS (SELECT doc_id AS id, {tokens_sql('text', 2)} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, count(*) AS n, max(round({PLUS} * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)), 6)) AS most FROM tf JOIN df USING (term), st GROUP BY id""")
def bm25_sparse_vectors(spark, d):
    found = S.bm25_weights(texts(spark, d))
    return found.select("id", F.size("sparse").cast("long").alias("n"), F.array_max(F.map_values("sparse")).alias("most"))


_STEM = " ".join(f"WHEN w LIKE '%{x}' AND length(w) - {len(x)} >= 3 THEN substr(w, 1, length(w) - {len(x)})" for x in X.LIGHT_SUFFIXES)


@register("light_stems", f"SELECT w AS term, CASE {_STEM} ELSE w END AS stem FROM (SELECT DISTINCT unnest({tokens_sql('text')}) AS w FROM documents)")
def light_stems(spark, d):
    terms = texts(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.light_stem(F.col("term")).alias("stem"))


# ---------------------------------------------------------------- fusion
_LISTS = f"{V_SQL}, {Q_SQL}, " + bm25_sql(TERMS, PLUS, 1.2, 0.75).strip() + ", dl AS (SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 50), tl AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 50), l AS (SELECT 'dense' AS source, id, score FROM dl UNION ALL SELECT 'text', id, score FROM tl), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM l)"


def two_lists(spark, d):
    dense = S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 50).select("id", "score")
    return U.sources(dense=dense, text=S.bm25(texts(spark, d), TERMS, 50).select("id", "score"))


@register("fusion_rrf", f"WITH {_LISTS} SELECT id, round(sum(1 / (60 + rank)), 6) AS score, count(*) AS n_sources FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10")
def fusion_rrf(spark, d):
    return U.rrf(two_lists(spark, d), 10)


@register("fusion_hybrid", f"WITH {_LISTS} SELECT id, round(sum(0.5 / (60 + rank)) * CASE WHEN count(*) > 1 THEN 1.1 ELSE 1 END, 6) AS score, count(*) AS n_sources FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10")
def fusion_hybrid(spark, d):
    dense = S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 50).select("id", "score")
    return U.hybrid(dense, S.bm25(texts(spark, d), TERMS, 50).select("id", "score"), 10)


@register("flagship_hybrid", ORACLES["fusion_hybrid"])
def flagship_hybrid(spark, d):
    return fusion_hybrid(spark, d)


_NORMS = {
    "minmax": "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END",
    "zscore": "CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0.0 END",
    "rank": "1 - (rank - 1) / count(*) OVER w",
}
for _method, _norm in _NORMS.items():
    register(f"fusion_linear_{_method}", f"WITH {_LISTS}, x AS (SELECT id, {_norm} AS norm, CASE source WHEN 'dense' THEN 0.7 ELSE 0.3 END AS wt FROM r WINDOW w AS (PARTITION BY source)) SELECT id, round(sum(norm * wt), 6) AS score FROM x GROUP BY id ORDER BY score DESC, id LIMIT 10")(
        lambda spark, d, m=_method: U.linear(two_lists(spark, d), 10, m, {"dense": 0.7, "text": 0.3}).select("id", "score")
    )


@register("fusion_condorcet", f"""WITH {_LISTS}, ids AS (SELECT DISTINCT id FROM r), p AS (SELECT a.id AS a, b.id AS b, s.source, coalesce(ra.rank, 1e9) AS x, coalesce(rb.rank, 1e9) AS y
FROM ids a, ids b, (SELECT DISTINCT source FROM r) s LEFT JOIN r ra ON ra.id = a.id AND ra.source = s.source LEFT JOIN r rb ON rb.id = b.id AND rb.source = s.source WHERE a.id <> b.id)
SELECT a AS id, CAST(sum(CASE WHEN x < y THEN 1 WHEN x > y THEN -1 ELSE 0 END) AS DOUBLE) AS score FROM p GROUP BY a ORDER BY score DESC, id LIMIT 10""")
def fusion_condorcet(spark, d):
    return U.condorcet(two_lists(spark, d), 10)


@register("fusion_explained", f"WITH {_LISTS} SELECT id, max(CASE WHEN source = 'dense' THEN rank END)::BIGINT AS dense_rank, max(CASE WHEN source = 'text' THEN rank END)::BIGINT AS text_rank FROM r GROUP BY id")
def fusion_explained(spark, d):
    parts = U.explain_sources(two_lists(spark, d))
    return parts.select("id", *[F.element_at("sources", s)["rank"].cast("long").alias(f"{s}_rank") for s in ("dense", "text")])


@register("rerank_exact", f"WITH {_LISTS} SELECT tl.id, round(coalesce(list_cosine_similarity(v, q), tl.score), 6) AS score FROM tl LEFT JOIN v USING (id), q ORDER BY score DESC, id LIMIT 10")
def rerank_exact(spark, d):
    hits = S.bm25(texts(spark, d), TERMS, 50)
    return U.rerank_exact(hits, vectors(spark, d), vector_of(spark, d, 0), 10).select("id", "score")


@register("rerank_weighted", f"WITH {_LISTS} SELECT id, round(0.7 * score + 0.2 * (id % 10) / 10, 6) AS score FROM dl ORDER BY 2 DESC, id LIMIT 10")
def rerank_weighted(spark, d):
    hits = S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 50).withColumn("text_score", (F.col("id") % 10) / 10)
    return U.rerank_weighted(hits, 10).select("id", "score")


@register("rerank_mmr")
def rerank_mmr(spark, d):
    hits = S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 100)
    return U.mmr(hits, vectors(spark, d), 10).select("id", "score", "mmr_rank")


@register("hybrid_late", f"WITH {_LISTS}, {_TOK}, h AS (SELECT id, round(sum(1 / (60 + rank)), 6) AS a FROM r GROUP BY id ORDER BY a DESC, id LIMIT 30), m AS (SELECT b.id, a.pos, max(list_cosine_similarity(a.vec, b.vec)) AS s FROM tok a, tok b WHERE a.id = 0 GROUP BY ALL), c AS (SELECT id, round(sum(s), 6) AS b FROM m GROUP BY id), j AS (SELECT h.id, a, b FROM h LEFT JOIN c USING (id)) SELECT id, round(0.6 * a + 0.4 * coalesce(b, 0) / (SELECT greatest(max(b), 1e-6) FROM j), 6) AS score FROM j ORDER BY score DESC, id LIMIT 10")
def hybrid_late(spark, d):
    t = token_vectors(spark, d)
    late = S.maxsim(t, t.where("id = 0").select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec")), None)
    return U.blend_max(U.rrf(two_lists(spark, d), 30), late, 10).select("id", "score")


# ---------------------------------------------------------------- one handle on a collection
QUESTION = " ".join(TERMS)


@register("search_modes", f"WITH {_LISTS}, h AS (SELECT id, round(sum(0.5 / (60 + rank)) * CASE WHEN count(*) > 1 THEN 1.1 ELSE 1 END, 6) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10) SELECT 'dense' AS mode, * FROM (SELECT id, score FROM dl ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT 'sparse', * FROM (SELECT id, score FROM tl ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT 'hybrid', id, score FROM h")
def search_modes(spark, d):
    # vectors without a document and documents without a vector stay in: each mode sees what it can score
    points_ = vectors(spark, d).join(texts(spark, d), "id", "full_outer")
    handle, q, out = E.Collection(points_), vector_of(spark, d, 0), None
    for mode in ("dense", "sparse", "hybrid"):
        part = handle.search(QUESTION, q, 10, mode).select(F.lit(mode).alias("mode"), "id", "score")
        out = part if out is None else out.unionAll(part)
    return out


_ENTERPRISE = f"{V_SQL}, {Q_SQL}, a AS ({_ACL}), t AS (SELECT v.id, v.label, round(list_cosine_similarity(v, q), 6) AS score FROM v JOIN a ON a.doc_id = v.id JOIN documents s ON s.doc_id = v.id, q WHERE n_chars > 300 AND (list_contains(acl, 'public') OR (NOT list_contains(acl, 'deny:user:ann') AND (list_contains(acl, 'ann') OR list_contains(acl, 'group:en')))) ORDER BY score DESC, v.id LIMIT 50)"


def _enterprise(spark, d):
    lists = acl_documents(spark, d).select(F.col("doc_id").alias("id"), F.col("acl").alias("_acl"))
    handle = E.Collection(points(spark, d).join(lists, "id"))
    return handle.enterprise(vector_of(spark, d, 0), 10, {"n_chars": {"$gt": 300}}, ["user:ann", "group:en"], ["label"], default_allow=False)


@register("search_enterprise", f"WITH {_ENTERPRISE} SELECT id, score FROM t ORDER BY score DESC, id LIMIT 10")
def search_enterprise(spark, d):
    return _enterprise(spark, d)[0]


@register("search_enterprise_facets", f"WITH {_ENTERPRISE}, c AS (SELECT CAST(label AS VARCHAR) AS value, count(*) AS n FROM t GROUP BY label), s AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10) SELECT 'label' AS field, value, n, (SELECT sum(n)::BIGINT FROM c) AS total, ((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s))::BIGINT AS other FROM s")
def search_enterprise_facets(spark, d):
    return _enterprise(spark, d)[1]


@register("text_vectors", "WITH p AS (SELECT doc_id, list_transform(range(8), lambda i: CAST(CAST('0x' || substr(md5(text || ':' || i), 1, 8) AS BIGINT) AS DOUBLE) / 2147483647.5 - 1) AS v FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM p")
def text_vectors(spark, d):
    v = table(spark, d, "documents").where("text is not null").select("doc_id", X.hash_vector(F.col("text"), 8).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[7], 6).alias("last"))


@register("relation_triplets", "SELECT n_nationkey, n_name AS head, 'part of' AS relation, r_name AS tail FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_nationkey, r_name, 'has part', n_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def relation_triplets(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    markup = F.concat(F.lit("<s><triplet> "), "n_name", F.lit(" <subj> part of <obj> "), "r_name", F.lit(" <triplet>"), "r_name", F.lit("<subj>has part<obj>"), "n_name", F.lit(" <triplet> cut <subj> off</s>"))
    return both.select("n_nationkey", F.explode(X.triplets(markup)).alias("t")).select("n_nationkey", "t.*")


@register("document_catalogue", "SELECT doc_id, len(string_split(text, chr(10))) AS n_nodes, CAST(ceil(len(string_split(text, chr(10))) / 3) AS BIGINT) AS n_top FROM documents")
def document_catalogue(spark, d):
    return D.catalogue(D.sections(headed(spark, d)))


@register("sync_collections", "SELECT * FROM (VALUES ('broken', 0::BIGINT, 0::BIGINT, 0::BIGINT, true), ('new', (SELECT count(*) FROM nation), 0, 0, false), ('orders', (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0), (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0), (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0), false)) t(name, added, updated, removed, failed)")
def sync_collections(spark, d):
    every = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lit(1).alias("updated_at"))
    fresh = every.where("id % 7 <> 0 or id % 5 = 0").withColumn("updated_at", F.when(F.col("id") % 4 == 0, 2).otherwise(1))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(1).alias("updated_at"))
    report = M.sync_all({"orders": fresh, "new": nation, "broken": nation.select("id")}, {"orders": every.where("id % 5 <> 0"), "broken": nation})[1]
    return report.select("name", "added", "updated", "removed", F.col("error").isNotNull().alias("failed"))


@register("knn_inverted_file", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
def knn_inverted_file(spark, d):
    """All cells probed: the same rows as exact search (recall at fewer probes is tested on its own)."""
    from lodestone.operators.ann import Cells

    p = vectors(spark, d)
    cells = Cells.fit(p, 16)
    return cells.search(cells.index(p), vector_of(spark, d, 0), 10, probes=16).select("id", "score")


# ---------------------------------------------------------------- aggregates
@register("facet_counts", "WITH c AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 2), s AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 5) SELECT value, n, (SELECT sum(n)::BIGINT FROM c) AS total, ((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s))::BIGINT AS other FROM s")
def facet_counts(spark, d):
    return A.facet(table(spark, d, "documents"), "source", 5, 2)


@register("facet_lists", "WITH c AS (SELECT value, count(*) AS n FROM (SELECT unnest([lang, source]) AS value FROM documents) GROUP BY value), s AS (SELECT * FROM c ORDER BY value LIMIT 6) SELECT value, n, (SELECT sum(n)::BIGINT FROM c) AS total, ((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s))::BIGINT AS other FROM s")
def facet_lists(spark, d):
    return A.facet(table(spark, d, "documents").withColumn("tags", F.array("lang", "source")), "tags", 6, by_value=True)


_FACETS = "SELECT '{0}' AS field, value, n, (SELECT sum(n)::BIGINT FROM {0}_c) AS total, ((SELECT sum(n) FROM {0}_c) - (SELECT sum(n) FROM {0}_s))::BIGINT AS other FROM {0}_s"
_FACET_CTES = ", ".join(f"{f}_c AS (SELECT CAST({f} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY {f}), {f}_s AS (SELECT * FROM {f}_c ORDER BY n DESC, value LIMIT 4)" for f in ("p_brand", "p_size"))


@register("facets_multi", f"WITH {_FACET_CTES} " + " UNION ALL ".join(_FACETS.format(f) for f in ("p_brand", "p_size")))
def facets_multi(spark, d):
    return A.facets(table(spark, d, "part"), ["p_brand", "p_size"], 4)


@register("search_facets", f"WITH {V_SQL}, {Q_SQL}, t AS (SELECT id, label, round(list_cosine_similarity(v, q), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 100), c AS (SELECT CAST(label AS VARCHAR) AS value, count(*) AS n FROM t GROUP BY label), s AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 10) SELECT 'label' AS field, value, n, (SELECT sum(n)::BIGINT FROM c) AS total, ((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s))::BIGINT AS other FROM s")
def search_facets(spark, d):
    return A.search_with_facets(vectors(spark, d), vector_of(spark, d, 0), ["label"])[1]


@register("search_acl", f"WITH {V_SQL}, {Q_SQL}, a AS ({_ACL}) SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM v JOIN a ON a.doc_id = v.id, q WHERE list_contains(acl, 'public') OR (NOT list_contains(acl, 'deny:user:ann') AND (list_contains(acl, 'ann') OR list_contains(acl, 'group:en'))) ORDER BY score DESC, id LIMIT 10")
def search_acl(spark, d):
    p = vectors(spark, d).join(acl_documents(spark, d).select(F.col("doc_id").alias("id"), F.col("acl").alias("_acl")), "id")
    return A.search_with_acl(p, vector_of(spark, d, 0), ["user:ann", "group:en"], 10).select("id", "score")


@register("field_stats", "SELECT count(p_retailprice) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high, count(DISTINCT p_retailprice) AS n_unique FROM part")
def field_stats(spark, d):
    return A.field_stats(table(spark, d, "part"), "p_retailprice")


@register("latency_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return A.latency_summary(table(spark, d, "events"), "value", ["event_type"])


@register("latency_nearest_rank", "WITH s AS (SELECT list(value ORDER BY value) AS l, count(*) AS n FROM events WHERE value IS NOT NULL) SELECT l[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, l[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99 FROM s")
def latency_nearest_rank(spark, d):
    return A.nearest_rank(table(spark, d, "events"), "value")


@register("latency_histogram", "WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(least(floor((value - a) / ((b - a) / 20)), 19) AS INT) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), "value", 20)


@register("retrieval_metrics", _JOIN + """, k AS (SELECT qid, id, rank FROM r WHERE rank <= 10), t AS (SELECT a.id AS qid, b.id FROM v a JOIN v b USING (label)),
z AS (SELECT qid, count(DISTINCT id) AS rel FROM t GROUP BY qid), h AS (SELECT k.qid, count(t.id) AS hits, min(CASE WHEN t.id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN t.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM k LEFT JOIN t ON t.qid = k.qid AND t.id = k.id GROUP BY k.qid)
SELECT qid, round(hits / rel, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM z JOIN h USING (qid)""")
def retrieval_metrics(spark, d):
    p = vectors(spark, d)
    found = S.knn_join(p, p.select(F.col("id").alias("qid"), F.col("vector").alias("qvector")), 10)
    # relevant are the vectors of the query's label: their number is a count, and hits carry their labels
    labels = p.select("id", "label")
    relevant = labels.join(labels.groupBy("label").agg(F.count("*").alias("relevant")), "label").select(F.col("id").alias("qid"), "relevant")
    judged = found.join(labels, "id").join(labels.select(F.col("id").alias("qid"), F.col("label").alias("asked")), "qid")
    return A.graded(judged.select("qid", "rank", (F.col("label") == F.col("asked")).alias("hit")), relevant, 10)


@register("redaction", "SELECT url, CASE WHEN length(url) > 8 THEN substr(url, 1, 4) || '***' || right(url, 4) ELSE url END AS shown FROM pages")
def redaction(spark, d):
    return table(spark, d, "pages").select("url", A.redact_id(F.col("url")).alias("shown"))


# ---------------------------------------------------------------- collections
@register("upsert", "SELECT id, label FROM (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 3 = 0)")
def upsert(spark, d):
    old = vectors(spark, d).select("id", "label")
    new = old.where("id % 3 = 0").withColumn("label", F.col("label") + 100)
    return C.upsert(old, new.union(new.withColumn("id", F.col("id") + 1_000_000)))


@register("delete_ids", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(spark, d):
    return C.delete(vectors(spark, d), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))).select("id")


@register("get_batch", "SELECT p.position, CAST(p.id AS BIGINT) AS id, e.label FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 8)) p(position, id) LEFT JOIN embeddings e ON e.vec_id = p.id")
def get_batch(spark, d):
    return C.get(vectors(spark, d), [5, 3, 999_999_999, 8]).select("position", "id", "label")


@register("merge_metadata", "SELECT doc_id AS id, lang, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS source FROM documents")
def merge_metadata(spark, d):
    p = texts(spark, d).select("id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"))
    changes = p.where("id % 2 = 0").select("id", F.create_map(F.lit("source"), F.lit("new")).alias("metadata"))
    return C.merge_metadata(p, changes).select("id", *[F.element_at("metadata", k).alias(k) for k in ("lang", "source")])


@register("page_of_ids", "SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100")
def page_of_ids(spark, d):
    return C.page(vectors(spark, d), 50, 100).select("id")


@register("scroll_filtered", "SELECT id, label FROM (SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 50) WHERE label < 5")
def scroll_filtered(spark, d):
    return C.scroll(vectors(spark, d), 100, 50, {"label": {"$lt": 5}})[0].select("id", "label")


@register("collection_totals", "SELECT label, count(*) AS n, count(*) * 64 AS floats FROM embeddings GROUP BY label")
def collection_totals(spark, d):
    return vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("floats"))


@register("sync_status", "SELECT lang AS name, count(*) AS source, count(*) FILTER (doc_id % 4 <> 0) AS target, greatest(0, count(*) - count(*) FILTER (doc_id % 4 <> 0)) AS pending FROM documents GROUP BY lang")
def sync_status(spark, d):
    named = table(spark, d, "documents").select("doc_id", F.col("lang").alias("name"))
    return A.sync_status(named, named.where("doc_id % 4 <> 0"))


@register("change_capture", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0")
def change_capture(spark, d):
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    first = target.where("id % 5 IN (0, 1)").select("id", F.lit("Y").alias("status"), F.lit("update").alias("op"), F.lit(1).alias("seq"))
    last = target.where("id % 5 IN (0, 1)").select("id", F.lit("X").alias("status"), F.when(F.col("id") % 5 == 0, "delete").otherwise("update").alias("op"), F.lit(2).alias("seq"))
    return M.apply_changes(target, first.union(last))


@register("windowed_metrics", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def windowed_metrics(spark, d):
    return M.windowed_metrics(table(spark, d, "events"), "1 hour", by=["event_type"])


@register("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return M.sessions(table(spark, d, "events"))


# ---------------------------------------------------------------- quantization
_SQ8 = "m AS (SELECT i, min(v[i]) AS a, greatest(max(v[i]) - min(v[i]), 1e-8) / 255 AS s FROM v, range(1, 65) t(i) GROUP BY i), c AS (SELECT id, i, v[i] AS x, a, s, least(greatest(floor((v[i] - a) / s), 0), 255) AS k FROM v JOIN m ON true)"


@register("quantize_scalar", f"WITH {V_SQL}, {_SQ8} SELECT id, CAST(sum(k) AS BIGINT) AS total, CAST(max(k) AS INT) AS high FROM c GROUP BY id")
def quantize_scalar(spark, d):
    p = vectors(spark, d)
    return Q.scalar_encode(p, Q.scalar_fit(p)).select("id", F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("code").alias("high"))


@register("quantize_scalar_error", f"WITH {V_SQL}, {_SQ8}, e AS (SELECT id, sqrt(sum(pow(x - (k * s + a), 2))) / sqrt(sum(x * x)) AS e FROM c GROUP BY id) SELECT round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error FROM e")
def quantize_scalar_error(spark, d):
    p = vectors(spark, d)
    return Q.quantization_error(Q.scalar_encode(p, Q.scalar_fit(p)))


@register("quantize_binary", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) / 64, 6) AS distance FROM v, q ORDER BY distance, id LIMIT 20")
def quantize_binary(spark, d):
    p = vectors(spark, d)
    coded = Q.binary_encode(p, Q.binary_thresholds(p))
    q = coded.where("id = 0").select("words").head()[0]
    words = F.array(*[F.lit(w).cast("long") for w in q])
    return coded.select("id", F.round(Q.binary_distance(F.col("words"), words, 64), 6).alias("distance")).orderBy("distance", "id").limit(20)


@register("quantize_binary_asymmetric", f"WITH {V_SQL}, {Q_SQL} SELECT id, round(1 - (list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE -p[2] END)) / sqrt(list_sum(list_transform(q, lambda x: x * x))) / 64 + 1) / 2, 6) AS distance FROM v, q")
def quantize_binary_asymmetric(spark, d):
    p = vectors(spark, d)
    coded = Q.binary_encode(p, Q.binary_thresholds(p))
    return coded.select("id", F.round(Q.binary_asymmetric(F.col("bits"), vector_of(spark, d, 0)), 6).alias("distance"))


@register("quantize_product")
def quantize_product(spark, d):
    p = vectors(spark, d)
    books = Q.product_fit(p, 8, 16, iterations=5)
    coded = Q.product_encode(p, books)
    return coded.select("id", F.round(Q.product_distance(vector_of(spark, d, 0), books), 6).alias("distance")).orderBy("distance", "id").limit(10)


# ---------------------------------------------------------------- graph: customers and the parts they order
_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, 1000000 + l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def order_edges(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).distinct()


@register("graph_neighbours", f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), w(node, depth) AS (SELECT (SELECT min(src) FROM e), 0 UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 2)
SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node""")
def graph_neighbours(spark, d):
    edges = order_edges(spark, d)
    return G.neighbours(edges, edges.agg(F.min("src").alias("node")), 2)


@register("graph_subgraph", f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), w(node, depth) AS (SELECT (SELECT min(src) FROM e), 0 UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 2)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM w) AND dst IN (SELECT node FROM w)""")
def graph_subgraph(spark, d):
    edges = order_edges(spark, d)
    return G.subgraph(edges, edges.agg(F.min("src").alias("node")), 2)[1].select("src", "dst")


@register("graph_importance", f"WITH {_EDGES}, n AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM n), 6) AS importance FROM n")
def graph_importance(spark, d):
    return G.importance(order_edges(spark, d))


# reached from the least node; what is not reached would be missing here and show as a difference
@register("graph_components", f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), w(node) AS (SELECT min(src) FROM e UNION SELECT b.dst FROM w JOIN b ON b.src = w.node) SELECT min(node) AS component, count(*) AS n FROM w")
def graph_components(spark, d):
    return G.components(order_edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@register("graph_components_regions", "SELECT CAST(r_regionkey * 1000 AS BIGINT) AS component, count(*) + 1 AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def graph_components_regions(spark, d):
    edges = table(spark, d, "nation").select((F.col("n_regionkey") * 1000).cast("long").alias("src"), (F.col("n_nationkey") + 100_000).cast("long").alias("dst"))
    return G.components(edges).groupBy("component").agg(F.count("*").alias("n"))


@register("graph_communities", "SELECT CAST(n_regionkey AS BIGINT) AS community, count(*) + 1 AS n FROM nation GROUP BY n_regionkey")
def graph_communities(spark, d):
    edges = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"), F.lit(1.0).alias("strength"))
    return G.communities(edges).where("level = 0").groupBy("community").agg(F.count("*").alias("n"))


def units(spark, d):
    """Texts of all documents. Letters and digits beyond ASCII become 0, and other such characters spaces, so that both
    engines see the same word boundaries; places stay."""
    text = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "0")
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit"), text.alias("text"))


_RUN = r"'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'"
_UNITS = r"u AS (SELECT doc_id AS unit, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g') AS text FROM documents)"
_NAMES = _UNITS + rf""", z AS (SELECT unit, regexp_split_to_array(text, {_RUN}) AS gaps, regexp_extract_all(text, {_RUN}) AS runs FROM u),
f AS (SELECT unit, i, gaps[i] AS gap, runs[i] AS raw FROM (SELECT unit, gaps, runs, unnest(range(1, len(runs) + 1)) AS i FROM z)),
n AS (SELECT unit, raw, CAST(sum(length(gap) + length(raw)) OVER (PARTITION BY unit ORDER BY i) - length(raw) AS BIGINT) AS position FROM f), m AS (SELECT unit, position, regexp_replace(raw, '\s+', ' ', 'g') AS name FROM n WHERE length(regexp_replace(raw, '\s+', ' ', 'g')) BETWEEN 2 AND 100)"""
_KIND = "CASE WHEN regexp_matches(lower(name), 'inc|corp|ltd|company|co') THEN 'ORGANIZATION' WHEN regexp_matches(lower(name), 'city|country|state|street') THEN 'LOCATION' ELSE 'OTHER' END"
_NOT = "lower(name) NOT IN ('the', 'a', 'an', 'this', 'that', 'it', 'he', 'she', 'they')"
_RELATIONS = f"""t AS (SELECT unit, position AS p, lower(name) AS k, {_KIND} AS kind FROM m WHERE {_NOT}),
x AS (SELECT a.unit, least(a.k, b.k) AS src, greatest(a.k, b.k) AS dst, a.p AS pa, b.p AS pb, CASE WHEN a.kind <> b.kind AND a.kind IN ('ORGANIZATION', 'LOCATION') AND b.kind IN ('ORGANIZATION', 'LOCATION') THEN 'located_in' ELSE 'related_to' END AS type
  FROM t a JOIN t b ON a.unit = b.unit AND b.p BETWEEN a.p AND a.p + 200 AND a.k <> b.k),
y AS (SELECT *, row_number() OVER (PARTITION BY unit, src, dst ORDER BY pa, pb, type) AS r FROM x)"""


@register("entity_mentions", f"WITH {_NAMES} SELECT unit, position, name, {_KIND} AS type FROM m WHERE {_NOT}")
def entity_mentions(spark, d):
    return G.extract_entities(units(spark, d)).withColumn("position", F.col("position").cast("long"))


@register("graph_entities", f"WITH {_NAMES} SELECT lower(name) AS id, min(name) AS name, min({_KIND}) AS type, count(DISTINCT unit) AS n_units, count(*) AS n_mentions FROM m WHERE {_NOT} GROUP BY lower(name)")
def graph_entities(spark, d):
    return G.merge_entities(G.extract_entities(units(spark, d))).drop("aliases")


@register("graph_relations", f"WITH {_NAMES}, {_RELATIONS} SELECT src, dst, type, least(1.0, round(avg(greatest(0.3, 1 - (pb - pa) / 200)) + 1e-9, 6)) AS strength, count(*) AS n_sources FROM y WHERE r = 1 GROUP BY src, dst, type")
def graph_relations(spark, d):
    return G.build(units(spark, d))[1]


@register("graph_local_search")
def graph_local_search(spark, d):
    entities, edges = G.build(units(spark, d))
    return G.local_search(entities, edges, "the erth and", 10, 1)


def _counted(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '{p}') AS DOUBLE)" for p in patterns)


@register("classify_questions", rf"""WITH w AS (SELECT conv_id, turn, lower(text) AS low, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, {_counted(G.CONNECTED)} AS c, {_counted(G.SPECIFIC)} + CASE WHEN len(list_filter(words, lambda x: regexp_matches(x, '^\p{{Lu}}.'))) >= 2 THEN 1 ELSE 0 END + CASE WHEN len(words) <= 5 THEN 0.5 ELSE 0 END AS a,
{_counted(G.BROAD)} + CASE WHEN len(words) > 10 THEN 0.5 ELSE 0 END AS b FROM w)
SELECT conv_id, turn, CASE WHEN c > 0 THEN 'relationship' WHEN a > b THEN 'specific' WHEN b > a THEN 'broad' ELSE 'mixed' END AS kind FROM s""")
def classify_questions(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", G.classify(F.col("text")).alias("kind"))


@register("graph_fusion", "WITH l(id, s) AS (SELECT vec_id, label / 10 FROM embeddings WHERE vec_id % 2 = 0), g(id) AS (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) SELECT id, round(CASE WHEN s IS NULL THEN 0.2 WHEN g.id IS NULL THEN 0.6 * s ELSE 0.6 * s + 0.4 END, 6) AS score FROM l FULL JOIN g USING (id) ORDER BY score DESC, id LIMIT 20")
def graph_fusion(spark, d):
    p = vectors(spark, d)
    return G.fuse_local_global(p.where("id % 2 = 0").select("id", (F.col("label") / 10).alias("score")), p.where("id % 3 = 0"), 20)


# ---------------------------------------------------------------- document trees: headings made from the lines
def headed(spark, d):
    lines = F.split("text", "\n")
    made = F.array_join(F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" S"), i.cast("string"), F.lit("\n"), x)), "\n")
    return table(spark, d, "documents").select("doc_id", made.alias("text"))


@register("document_sections", "SELECT doc_id, i AS position, CAST(i % 3 + 1 AS INT) AS level, 'S' || i AS title, CASE WHEN i % 3 = 0 THEN NULL ELSE i - 1 END AS parent FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def document_sections(spark, d):
    s = D.sections(headed(spark, d))
    return s.select("doc_id", (F.col("position") - 1).cast("long").alias("position"), "level", "title", (F.col("parent") - 1).cast("long").alias("parent"))


@register("document_paths", "SELECT doc_id, i AS position, array_to_string(list_transform(range(i - i % 3, i + 1), lambda k: 'S' || k), ' > ') AS path FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def document_paths(spark, d):
    p = D.section_paths(D.sections(headed(spark, d)))
    return p.select("doc_id", (F.col("position") - 1).cast("long").alias("position"), F.array_join("path", " > ").alias("path"))


@register("document_paragraphs", r"SELECT doc_id, i - 1 AS position, length(regexp_replace(p[i], '^\s+|\s+$', '', 'g')) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n') AS p FROM documents)) WHERE regexp_replace(p[i], '^\s+|\s+$', '', 'g') <> ''")
def document_paragraphs(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return D.paragraphs(docs).select("doc_id", F.col("position").cast("long").alias("position"), F.length("text").cast("long").alias("n"))


@register("document_changes", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def document_changes(spark, d):
    docs = table(spark, d, "documents")
    known = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("hash"))
    return D.changed(docs, known).select("doc_id")


@register("document_stats", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def document_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("document_chunks")
def document_chunks(spark, d):
    return D.node_chunks(D.sections(headed(spark, d)), size=300, overlap=50)


# ---------------------------------------------------------------- relational shapes the engine is built on
@register("asof_join", "SELECT event_id, (SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id = e1.user_id AND e2.event_type = 'purchase' AND e2.ts < e1.ts AND e2.ts = (SELECT max(e3.ts) FROM events e3 WHERE e3.user_id = e1.user_id AND e3.event_type = 'purchase' AND e3.ts < e1.ts)) AS last_purchase FROM events e1 WHERE event_type <> 'purchase'")
def asof_join(spark, d):
    events = table(spark, d, "events")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    # in microseconds: a purchase at the same moment is not before
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(bought).over(before)
    return events.withColumn("p", last).where("event_type <> 'purchase'").select("event_id", F.col("p.event_id").alias("last_purchase"))


@register("top_terms", f"SELECT item_id, term, n FROM (SELECT item_id, term, n, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS r FROM (SELECT item_id, term, count(*) AS n FROM (SELECT doc_id AS item_id, unnest({tokens_sql('text', 3, True)}) AS term FROM documents) GROUP BY ALL)) WHERE r <= 5")
def top_terms(spark, d):
    tf, _ = S.term_counts(table(spark, d, "documents").withColumnRenamed("doc_id", "item_id"), "item_id")
    by = Window.partitionBy("item_id").orderBy(F.desc("tf"), "term")
    return tf.withColumn("r", F.row_number().over(by)).where("r <= 5").select("item_id", "term", F.col("tf").alias("n"))


@register("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@register("compare_runs", "SELECT p_brand AS name, round((max(p_retailprice) - min(p_retailprice)) / min(p_retailprice) * 100, 6) AS change, CASE WHEN round((max(p_retailprice) - min(p_retailprice)) / min(p_retailprice) * 100, 6) > 5 THEN 'improved' ELSE 'unchanged' END AS verdict FROM part GROUP BY p_brand")
def compare_runs(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"))
    return A.compare_runs(g.agg(F.min("p_retailprice").alias("value")), g.agg(F.max("p_retailprice").alias("value")))


@register("add_validated", "SELECT CASE WHEN vec_id % 5 = 0 THEN 'expected 64 dimensions, got 8' WHEN vec_id % 7 = 0 THEN 'no vector' END AS error, count(*) AS n FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 7 = 0 GROUP BY 1")
def add_validated(spark, d):
    k = F.col("id")
    p = vectors(spark, d).withColumn("vector", F.when(k % 5 == 0, F.slice("vector", 1, 8)).when(k % 7 != 0, F.col("vector")))
    return C.validate(p, 64)[1].groupBy("error").agg(F.count("*").alias("n"))


@register("section_lookup", "SELECT doc_id, i AS position FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE i = 1")
def section_lookup(spark, d):
    return D.find_section(D.sections(headed(spark, d)), "s1").select("doc_id", (F.col("position") - 1).cast("long").alias("position"))


@register("maxsim_prefetch")
def maxsim_prefetch(spark, d):
    t = token_vectors(spark, d)
    q = t.where("id = 0").select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec"))
    cents = S.centroids(t)
    mine = list(cents.where("id = 0").head()["centroid"])
    near = S.top(cents.withColumn("score", V.dot("centroid", mine)), 100).select("id")
    return S.maxsim(t.join(near, "id", "left_semi"), q, 10)


@register("fusion_dense_sparse_late")
def fusion_dense_sparse_late(spark, d):
    t = token_vectors(spark, d)
    late = S.maxsim(t, t.where("id = 0").select(F.col("pos").alias("qpos"), F.col("vec").alias("qvec")), 30)
    dense = S.vector_search(vectors(spark, d), vector_of(spark, d, 0), 50).select("id", "score")
    return U.dense_sparse_late(dense, S.sparse_search(term_postings(spark, d), SPARSE_QUERY, 50), late, 10)


@register("query_expansion", "SELECT * FROM (VALUES ('erre', 1.0::DOUBLE), ('haea', 0.4::DOUBLE), ('inth', 0.7::DOUBLE), ('tion', 1.0::DOUBLE)) t(term, weight)")
def query_expansion(spark, d):
    found = S.expand_query(["tion", "erre"], {"tion": ["inth"]}, {"erre": {"haea": 0.4}})
    return spark.createDataFrame(sorted(found.items()), "term string, weight double")


@register("graph_seeds", f"WITH {_NAMES}, e AS (SELECT DISTINCT lower(name) AS id FROM m WHERE {_NOT}) SELECT id, CASE WHEN contains('the erth and', id) OR contains(id, 'the erth and') THEN 1.0::DOUBLE ELSE round(0.8 * len(list_intersect(list_distinct(string_split(id, ' ')), ['the', 'erth', 'and'])) / greatest(3, len(list_distinct(string_split(id, ' ')))), 6) END AS score FROM e WHERE contains('the erth and', id) OR contains(id, 'the erth and') OR list_has_any(string_split(id, ' '), ['the', 'erth', 'and']) ORDER BY score DESC, id LIMIT 10")
def graph_seeds(spark, d):
    return G.seeds(G.merge_entities(G.extract_entities(units(spark, d))).drop("aliases"), "the erth and", 10)


@register("graph_community_search")
def graph_community_search(spark, d):
    entities, edges = G.build(units(spark, d))
    members = G.components(edges).withColumnRenamed("component", "community")
    found = G.community_summaries(members, entities).select(F.col("community").alias("id"), "size", "summary", F.lit(0.5).alias("importance"))
    return G.global_search(found, "which entities erth", 5).select("id", "size", "score")


@register("graph_resolution")
def graph_resolution(spark, d):
    return G.resolve_names(G.entity_ids(units(spark, d)))


@register("graph_edges_of_hits", f"WITH {_EDGES} SELECT src, dst FROM e WHERE src % 3 = 1 AND dst % 2 = 0")
def graph_edges_of_hits(spark, d):
    edges = order_edges(spark, d).withColumn("strength", F.lit(1.0))
    ends = edges.select(F.col("src").alias("id")).where("id % 3 = 1").union(edges.select(F.col("dst").alias("id")).where("id % 2 = 0 AND id >= 1000000")).distinct()
    return G.local_edges(edges.where("dst % 2 = 0"), ends).select("src", "dst")


def scratch(spark, name: str) -> str:
    """A new folder where other executors see it."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@register("source_jsonl", _NATION)
def source_jsonl(spark, d):
    from lodestone.sources import readers as R

    nation, path = table(spark, d, "nation"), scratch(spark, "jsonl")
    nation.write.json(path)
    return R.read_jsonl(spark, path, nation.schema)


@register("source_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS col_0, n_name AS col_1, CAST(n_regionkey AS VARCHAR) AS col_2 FROM nation")
def source_csv(spark, d):
    from lodestone.sources import readers as R

    path = scratch(spark, "csv")
    table(spark, d, "nation").write.csv(path, sep="|")
    return R.read_csv(spark, path, "|", False)


@register("source_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def source_parquet_columns(spark, d):
    from lodestone.sources import readers as R

    return R.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


@register("source_points", "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS n, label FROM embeddings")
def source_points(spark, d):
    from lodestone.sources import readers as R

    p = R.read_vectors(spark, f"{d}/embeddings.parquet", "parquet", "vec_id", "embedding")
    return p.select("id", F.size("vector").cast("long").alias("n"), F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@register("stream_upsert", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status FROM orders")
def stream_upsert(spark, d):
    source, target = scratch(spark, "stream"), scratch(spark, "target")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(2).alias("updated_at"))
    orders.where("id % 2 = 0").withColumn("status", F.lit("old")).withColumn("updated_at", F.lit(1)).write.parquet(source)
    orders.write.mode("append").parquet(source)
    M.upsert_stream(M.file_stream(spark, source, orders.schema, 1000), target, scratch(spark, "offsets")).awaitTermination()
    return M.read_versions(spark, target).select("id", "status")


@register("sync_incremental", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS status FROM orders")
def sync_incremental(spark, d):
    target = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lit("old").alias("status"), F.lit(1).alias("updated_at"))
    source = target.select("id", F.lit("new").alias("status"), F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("updated_at"))
    return M.sync_changes(source, target).select("id", "status")
