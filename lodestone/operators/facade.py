"""One handle on a collection: add, delete, count, get, and a search in every mode.

A Collection is a value: add() and delete() give a new one over the changed rows, written nowhere until somebody
asks (operators.collection.Database keeps collections as tables). Points have id and vector, and where needed text,
token vectors, metadata columns and an access list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.filters import acl_predicate, compile_filter
from lodestone.operators import aggregates, collection, fusion, search

MODES = ("dense", "sparse", "hybrid", "ultimate", "graph")
RERANKS = ("exact", "mmr", "weighted", "model")


def query_terms(query: str, least: int = 3) -> list[str]:
    """The words of a question that keyword search looks for."""
    return [w for w in re.findall(r"[a-z0-9]+", query.lower()) if len(w) >= least and w not in X.STOPWORDS]


@dataclass(frozen=True)
class Collection:
    points: DataFrame
    metric: str = "cosine"
    #: Texts to vectors: a function of a list of strings, for the query and for points that come without a vector.
    embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    #: Token vectors (id, pos, vec) of the points, and a function that gives a query's (qpos, qvec) as a DataFrame.
    tokens: DataFrame | None = None
    query_tokens: Callable[[str], DataFrame] | None = None
    #: Scores a query against a list of texts, for rerank="model".
    score_pairs: Callable[[str, list[str]], list[float]] | None = None
    #: A question's hits (id, score) from a graph, for mode="graph".
    graph: Callable[[str, int], DataFrame] | None = None
    acl_col: str = "_acl"

    # ------------------------------------------------------------ points
    def add(self, new: DataFrame) -> "Collection":
        """Upsert: rows of new replace those with the same id. Points without a vector column are embedded by their text."""
        if "vector" not in new.columns:
            if self.embed is None:
                raise ValueError("points without vectors need an embed function")
            new = new.withColumn("vector", self._embedded("text"))
        return replace(self, points=collection.upsert(self.points, new))

    def _embedded(self, column: str):
        embed = self.embed

        @F.pandas_udf("array<float>")
        def run(texts):
            import pandas as pd

            return pd.Series([[float(x) for x in v] for v in embed(texts.fillna("").tolist())])

        return run(column)

    def delete(self, ids: Sequence) -> "Collection":
        kind = self.points.schema["id"].dataType.simpleString()
        return replace(self, points=collection.delete(self.points, self.points.sparkSession.createDataFrame([(i,) for i in ids], f"id {kind}")))

    def clear(self) -> "Collection":
        return replace(self, points=self.points.limit(0))

    def count(self) -> int:
        return self.points.count()

    def get(self, ids: Sequence) -> DataFrame:
        return collection.get(self.points, list(ids))

    # ------------------------------------------------------------ search
    def readable(self, where=None, principals: list[str] | None = None, default_allow: bool = False) -> DataFrame:
        """The points that pass a metadata filter and that the principals may read; both come before any top-k."""
        rows = self.points
        if where is not None:
            rows = rows.where(compile_filter(where, rows.schema) if isinstance(where, dict) else where)
        if principals is not None:
            rows = rows.where(acl_predicate(F.col(self.acl_col), principals, default_allow))
        return rows

    def _vector(self, query: str | None, vector) -> list[float]:
        if vector is not None:
            return list(vector)
        if query is None or self.embed is None:
            raise ValueError("dense search needs a vector, or a query and an embed function")
        return [float(x) for x in self.embed([query])[0]]

    def search(self, query: str | None = None, vector=None, limit: int = 10, mode: str = "hybrid", where=None, principals: list[str] | None = None, rerank: str | None = None, diversity: float = 0.7, threshold: float | None = None, pool: int | None = None) -> DataFrame:
        """(id, score), best first.

        dense: nearest vectors. sparse: BM25 over the statistics of all points with a text. hybrid: rank fusion of both over pool hits
        each (five times the limit, 50 at least). ultimate: hybrid, blended with late interaction where there are token
        vectors, then by marginal relevance. graph: ultimate, fused with the graph's hits. rerank applies to dense and
        sparse hits.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}: one of {MODES}")
        if rerank is not None and rerank not in RERANKS:
            raise ValueError(f"unknown rerank {rerank!r}: one of {RERANKS}")
        rows, wide = self.readable(where, principals), pool or max(5 * limit, 50)

        def dense(k: int) -> DataFrame:
            return search.vector_search(rows, self._vector(query, vector), k, self.metric, threshold=threshold).select("id", "score")

        def sparse(k: int) -> DataFrame:
            if not query:
                raise ValueError("keyword search needs a query")
            return search.bm25(self.points.where("text is not null"), query_terms(query), k, within=rows).select("id", "score")

        if mode in ("dense", "sparse"):
            hits = (dense if mode == "dense" else sparse)(wide if rerank else limit)
            return self.rerank(hits, rerank, query, vector, limit, diversity) if rerank else hits
        hits = fusion.hybrid(dense(wide), sparse(wide), limit if mode == "hybrid" else wide).select("id", "score")
        if mode == "hybrid":
            return hits
        if self.tokens is not None and self.query_tokens is not None and query:
            late = search.maxsim(self.tokens.join(hits.select("id"), "id", "left_semi"), self.query_tokens(query), None)
            hits = fusion.blend_max(hits, late, wide)
        if mode == "graph":
            if self.graph is None:
                raise ValueError("graph search needs a graph function")
            hits = fusion.rrf(fusion.sources(text=hits, graph=self.graph(query, wide).join(rows.select("id"), "id", "left_semi")), wide).select("id", "score")
        return self.rerank(hits, "mmr", query, vector, limit, diversity)

    def rerank(self, hits: DataFrame, method: str, query: str | None = None, vector=None, limit: int = 10, diversity: float = 0.7) -> DataFrame:
        """Order hits (id, score) anew: exact cosine, marginal relevance, weighted parts, or a model's scores."""
        if method == "exact":
            return fusion.rerank_exact(hits, self.points, self._vector(query, vector), limit).select("id", "score")
        if method == "mmr":
            return fusion.mmr(hits, self.points, limit, trade=diversity).select("id", "score", "mmr_rank").orderBy("mmr_rank").select("id", "score")
        if method == "weighted":
            return fusion.rerank_weighted(hits, limit).select("id", "score")
        if self.score_pairs is None:
            raise ValueError("rerank='model' needs a function that scores pairs")
        return fusion.rerank_model(hits, self.points, query, self.score_pairs, limit).select("id", "score")

    def enterprise(self, vector, limit: int = 10, where=None, principals: list[str] | None = None, facets: list[str] | None = None, rerank: str | None = None, query: str | None = None, pool: int = 100, default_allow: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """Hits that the principals may read, re-ranked where asked, and facets over the whole pool (the reranked hits
        or five times the limit)."""
        rows = self.readable(where, principals, default_allow)
        wide = pool if rerank else 5 * limit
        hits = search.vector_search(rows, list(vector), wide, self.metric).select("id", "score")
        counts = aggregates.facets(self.points.join(hits.select("id"), "id", "left_semi"), facets) if facets else None
        return (self.rerank(hits, rerank, query, vector, limit) if rerank else search.top(hits, limit)), counts
