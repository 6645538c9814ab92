"""Operators on small frames: nulls, ties, empty tables, sequential algorithms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vector as V
from lodestone.functions.filters import acl_predicate, compile_filter
from lodestone.operators import collection as C
from lodestone.operators import documents as D
from lodestone.operators import fusion as U
from lodestone.operators import graph as G
from lodestone.operators import quantize as Q
from lodestone.operators import search as S
from lodestone.sources import readers as R
from lodestone.streaming import ingest as M


@pytest.fixture(scope="module")
def points(spark):
    rows = [("v1", [1.0, 0.0]), ("v2", [0.0, 1.0]), ("v3", [1.0, 0.0]), ("v4", [0.0, 0.0]), ("v5", None)]
    return spark.createDataFrame(rows, "id string, vector array<float>")


def test_search_ties_zero_and_null(points):
    assert [r.id for r in S.vector_search(points, [1, 0], 10).collect()] == ["v1", "v3", "v2", "v4"]
    assert [r.id for r in S.vector_search(points, [1, 0], 1, offset=1).collect()] == ["v3"]
    assert S.vector_search(points, [1, 0, 0], 5).count() == 0
    assert {r.id: r.score for r in S.vector_search(points, [0, 0], 4, "euclidean").collect()}["v4"] == 1.0


def test_knn_join_is_search(points, spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "qid int, qvector array<float>")
    for metric in V.DISTANCES.keys() - {"l2sq"}:
        joined = S.knn_join(points, q, 2, metric).collect()
        for r in q.collect():
            alone = [x.id for x in S.vector_search(points, r.qvector, 2, metric).collect()]
            assert [x.id for x in sorted(joined, key=lambda x: x["rank"]) if x.qid == r.qid] == alone


def test_filters_two_valued(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", []), (3, "y", None)], "id int, s string, l array<string>")

    def ids(spec):
        return [r.id for r in df.where(compile_filter(spec, df.schema)).orderBy("id").collect()]

    assert ids({"s": {"$ne": "x"}}) == [3]
    assert ids({"$not": {"s": "x"}}) == [1, 3]
    assert ids({"s": {"$is_null": True}}) == [1]
    assert ids({"l": {"$is_empty": True}}) == [2, 3]
    assert ids({"s": {"$regex": "("}}) == []
    assert ids({"must_not": [{"key": "s", "match": {"value": "x"}}, {"key": "s", "match": {"value": "y"}}]}) == [1]
    assert ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        compile_filter({"s": {"$like": 1}}, df.schema)


def test_acl(spark):
    rows = [(1, ["user:alice"]), (2, ["user:al"]), (3, ["deny:al", "public"]), (4, ["deny:user:al", "user:*"]), (5, None), (6, ["user:*"])]
    df = spark.createDataFrame(rows, "id int, acl array<string>")
    assert [r.id for r in df.where(acl_predicate(F.col("acl"), ["al"])).orderBy("id").collect()] == [2, 3, 6]
    assert 5 in [r.id for r in df.where(acl_predicate(F.col("acl"), ["al"], True)).collect()]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("running", "run"), ("relational", "relat"), ("happy", "happi"), ("is", "is"), ("adoption", "adopt")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_chunkers_advance():
    text = "One. " * 400
    for split in X.CHUNKERS.values():
        parts = split(text, 100, 20)
        assert parts and all(0 < len(p) <= 100 for p in parts)
        assert split("", 100, 20) == []
    assert X.split_headings("# A\nx\n## B\ny") == [("A", 1, "x"), ("B", 2, "y")]


def test_light_stemmers(spark):
    df = spark.createDataFrame([("running",), ("cities",), ("glass",), ("cats",)], "w string")
    assert [r[0] for r in df.select(X.rule_stem(F.col("w"))).collect()] == ["run", "city", "glass", "cat"]


def test_mmr_and_dedup(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    p = spark.createDataFrame(rows, "id int, vector array<double>")
    hits = S.vector_search(p, [1, 0.2], 3).select("id", "score")
    assert [r.id for r in U.mmr(hits, p, 2, 0.5).orderBy("mmr_rank").collect()][1] == 3
    assert sorted(r.id for r in S.greedy_dedup(p, 0.95).collect()) == [1, 3]


def test_quantizers(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "id int, vector array<double>")
    coded = Q.scalar_encode(p, Q.scalar_fit(p))
    assert Q.quantization_error(coded).head().max_error < 0.05
    books = Q.product_fit(p, 2, 4, iterations=3)
    assert books.shape == (2, 4, 4)
    row = Q.product_encode(p, books).head()
    gap = sum((a - b) ** 2 for a, b in zip([0.0] * 8, Q.product_decode(row.code, books)))
    got = Q.product_encode(p, books).where(F.col("id") == row.id).select(Q.product_distance([0.0] * 8, books).alias("d")).head().d
    assert abs(got - gap) < 1e-9


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (7, 8, 1.0), (9, 9, 1.0)], "src long, dst long, strength double")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in G.neighbours(edges, start, 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.node, r.component) for r in G.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert {r.node: r.degree for r in G.importance(edges).collect()}[9] == 1
    assert G.classify_query("How are Ann and Bob connected?") == "relationship"
    assert G.classify_query("Compare Ann and Bob. What is new, who is who?") == "relationship"
    assert G.classify_query("What are the main themes") == "broad" and G.classify_query("Where is Ann Berg") == "specific"
    assert G.classify_query("it rains on the wide and empty plains") == "mixed"
    units = spark.createDataFrame([(1, "Acme Corp met Paris City. The Acme Corp grew."), (2, None), (3, f"Anna Berg {'x' * 50} Carl  Dahl {'y' * 150} Emil")], "unit int, text string")
    mentions = {(r.unit, r.name): r.position for r in G.extract_entities(units).collect()}
    assert mentions == {(1, "Acme Corp"): 0, (1, "Paris City"): 14, (1, "The Acme Corp"): 26, (3, "Anna Berg"): 0, (3, "Carl Dahl"): 61, (3, "Emil"): 223}
    entities, relations = G.build(units.where("unit < 3"))
    assert {r.id: r.type for r in entities.collect()} == {"acme corp": "ORGANIZATION", "paris city": "LOCATION", "the acme corp": "ORGANIZATION"}
    assert relations.where("type = 'located_in'").count() == 2
    assert {(r.src, r.dst): r.strength for r in relations.collect()}["acme corp", "paris city"] == 0.93
    far = {(r.src, r.dst): r.strength for r in G.build(units.where("unit = 3"))[1].collect()}
    assert far == {("anna berg", "carl dahl"): 0.695, ("carl dahl", "emil"): 0.3}


def test_communities(spark):
    def cliques(sizes, bridges):
        edges, at = [], 0
        for n in sizes:
            edges += [(at + i, at + j, 1.0) for i in range(n) for j in range(i)]
            at += n
        return spark.createDataFrame(edges + bridges, "src long, dst long, strength double")

    found = G.communities(cliques([5, 5, 6], [(0, 5, 0.5), (5, 10, 0.5)]))
    base = {r.node: r.community for r in found.where("level = 0").collect()}
    assert base == {i: 0 if i < 5 else 5 if i < 10 else 10 for i in range(16)}
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 7)], "src long, dst long, strength double")
    assert {r.community for r in G.communities(star).where("level = 0").collect()} == {0}
    assert G.communities(star.limit(0)).count() == 0


def test_collection_handle(spark):
    import re as regex

    from lodestone.operators.facade import Collection, query_terms

    def embed(texts):
        return [[len(regex.findall(w, t)) + 0.01 for w in ("cat", "dog", "bird")] for t in texts]

    schema = "id string, text string, lang string, _acl array<string>"
    rows = [("a", "cat cat", "en", ["user:ann"]), ("b", "dog and cat", "en", ["public"]), ("c", "bird", "fr", None), ("d", "dog dog", "en", ["user:bob"])]
    empty = spark.createDataFrame([], "id string, vector array<float>, text string, lang string, _acl array<string>")
    handle = Collection(empty, embed=embed).add(spark.createDataFrame(rows, schema))
    assert handle.count() == 4 and [r.id for r in handle.get(["c", "zz"]).collect()] == ["c", "zz"]
    for mode in ("dense", "sparse", "hybrid", "ultimate"):
        assert handle.search("cat", limit=1, mode=mode).first().id in ("a", "b"), mode
    assert handle.search("cat cat", limit=1, mode="dense").first().id == "a"
    assert {r.id for r in handle.search("dog", mode="dense", where={"lang": "en"}, principals=["user:ann"]).collect()} == {"a", "b"}
    for method in ("exact", "mmr", "weighted"):
        assert handle.search("bird", limit=2, mode="dense", rerank=method).count() == 2
    paired = Collection(handle.points, embed=embed, score_pairs=lambda q, ts: [float("dog dog" in t) for t in ts], graph=lambda q, k: handle.points.where("id = 'c'").select("id", F.lit(1.0).alias("score")))
    assert paired.search("dog", limit=1, mode="dense", rerank="model").first().id == "d"
    assert "c" in {r.id for r in paired.search("dog", limit=4, mode="graph").collect()}
    hits, facets = handle.enterprise([1.0, 1.0, 0.0], 2, facets=["lang"], principals=["user:bob"], default_allow=False)
    assert {r.id for r in hits.collect()} == {"b", "d"} and {(r.value, r.n) for r in facets.collect()} == {("en", 2)}
    grown = handle.add(spark.createDataFrame([("a", "bird bird", "en", None), ("e", "cat", "en", None)], schema)).delete(["d", "none"])
    assert grown.count() == 4 and grown.search("bird", limit=1, mode="dense").first().id in ("a", "c") and grown.clear().count() == 0
    for bad in ({"mode": "odd"}, {"rerank": "odd"}, {"mode": "graph"}):
        with pytest.raises(ValueError):
            handle.search("cat", **bad)
    assert query_terms("The Cat, is on a mat-42") == ["cat", "mat"] or "cat" in query_terms("The Cat, is on a mat-42")


def test_knn_join_in_blocks(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import search as S

    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "POINT_BLOCK", 13)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0, 2.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x[:20])] + [("none", None), ("other", [1.0, 1.0])], "qid string, qvector array<double>")
    got = {}
    for r in S.knn_join(points, queries, 4, "euclidean").collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    assert got.pop("other") == {1: 101} and len(got) == 20
    for i in range(20):
        order = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:4]
        assert [got[f"q{i}"][r] for r in range(1, 5)] == order.tolist()
    assert S.knn_join(points.limit(0), queries, 4).count() == 0


def test_resolve_names(spark):
    e = spark.createDataFrame([("acme corp",), ("acme corq",), ("zeta",)], "id string")
    assert {(r.old, r.new) for r in G.resolve_names(e).collect()} == {("acme corp", "acme corp"), ("acme corq", "acme corp")}


def test_resolve_names_meets_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(9)
    names = {"anderson", "enderson", "new york city", "newyork city", "\u00e9clair shop", "eclair shop", "", "a", "ab"}
    for _ in range(60):
        name = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 24))).strip()
        names.add(name)
        for _ in range(2):
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "x", "yy"]) + name[at + rng.randint(0, 2) :]
            names.add(name)
    group = {n: n for n in names}
    pairs = {(a, b) for a in names for b in names if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.85}
    for _ in names:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    want = {(n, group[n]) for pair in pairs for n in pair}
    e = spark.createDataFrame([(n,) for n in names], "id string")
    assert {(r.old, r.new) for r in G.resolve_names(e).collect()} == want and ("enderson", "anderson") in want


@pytest.mark.parametrize("variants", [200, 20, 0])
def test_resolve_names_compares_few_pairs(spark, monkeypatch, variants):
    """Names made of few parts share all their pairs of characters; names beyond the limit on subsequences count as well."""
    import random
    from difflib import SequenceMatcher

    rng, parts = random.Random(3), ["th", "er", "on", "an", "re", "he", "ti", "es"]
    names = {"".join(rng.choice(parts) for _ in range(rng.choice([3, 4, 5, 6, 8, 11, 20]))) for _ in range(330)}
    for name in sorted(names)[::3]:
        at = rng.randrange(len(name))
        names.add(name[:at] + rng.choice(["", "q", "\u00e9", "\U0001f600"]) + name[at + 1 :])
    group = {n: n for n in names}
    pairs = [(a, b) for a in names for b in names if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.85]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    compared, persist = [], G.persist

    def watch(df):
        out = persist(df)
        if "alike" in out.columns:
            compared.append(out.count())
        return out

    monkeypatch.setattr(G, "persist", watch)
    monkeypatch.setattr(G, "VARIANTS", variants)
    e = spark.createDataFrame([(n,) for n in names], "id string")
    assert {(r.old, r.new) for r in G.resolve_names(e).collect()} == {(n, group[n]) for pair in pairs for n in pair}
    assert compared and (sum(compared) < 6 * len(names) or variants < 200)


def test_entity_ids(spark):
    units = spark.createDataFrame([(1, "The Big\nOak and Big  Oak He X Ann"), (2, None), (3, ""), (4, "no names")], "unit int, text string")
    assert {r.id for r in G.entity_ids(units).collect()} == {r.id for r in G.merge_entities(G.extract_entities(units)).collect()}
    assert {r.id for r in G.entity_ids(units).collect()} >= {"the big oak", "ann"}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n# C\nz"), (2, "")], "doc_id int, text string")
    nodes = D.sections(docs).orderBy("position").collect()
    assert [(n.title, n.level, n.text) for n in nodes] == [("A", 1, "x"), ("B", 2, "y"), ("C", 1, "z")]
    assert [r.path for r in D.section_paths(D.sections(docs)).orderBy("position").collect()] == [["A"], ["A", "B"], ["C"]]
    pages = spark.createDataFrame([(1, "--- Page 1 ---\na\n--- Page 2 ---\nb")], "doc_id int, text string")
    assert [(r.page, r.text) for r in D.pages(pages).orderBy("page").collect()] == [(1, "a"), (2, "b")]


def test_database(spark):
    db = C.Database(spark, "points_test")
    db.drop("c")
    db.create("c", 2)
    with pytest.raises(ValueError):
        db.create("c", 2)
    new = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "id string, vector array<float>")
    assert db.add("c", new) == 2 and db.add("c", new.where("id = 'a'")) == 0
    assert db.info("c")["count"] == 2 and db.info("c")["metric"] == "cosine"
    with pytest.raises(ValueError):
        db.add("c", spark.createDataFrame([("z", [1.0])], "id string, vector array<float>"))
    assert db.remove("c", spark.createDataFrame([("a",), ("q",)], "id string")) == 1
    assert db.drop("c") and not db.drop("c")
    with pytest.raises(KeyError):
        db.get("c")


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "vector": [1, 2], "text": "t", "k": 3}\n\nnot json\n{"id": "2", "text": "no vector"}\n')
    rows = R.read_vectors(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.id, r.vector, json.loads(r.metadata)["k"]) for r in rows] == [("1", [1.0, 2.0], 3)]
    (tmp_path / "b.csv").write_text("1,x\n2,y\n")
    assert R.read_csv(spark, str(tmp_path / "b.csv"), header=False).columns == ["col_0", "col_1"]
    assert R.count_lines(spark, str(tmp_path / "b.csv")) == 2
    np.save(tmp_path / "c.npy", np.arange(6).reshape(3, 2))
    assert R.read_vectors(spark, str(tmp_path / "c.npy")).count() == 3
    (tmp_path / "d.md").write_text("# T\nhello")
    row = R.read_texts(spark, str(tmp_path / "d.md")).head()
    assert (row.title, row.doc_type) == ("d", "markdown")


def test_upsert_stream(spark, tmp_path):
    schema = "id string, text string, updated_at timestamp"
    src = str(tmp_path / "in")
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")]]):
        spark.createDataFrame([(k, t) for k, t in rows], "id string, text string").withColumn("updated_at", F.lit(f"2024-01-0{i + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    stream = M.file_stream(spark, src, schema)
    M.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = {r.id: r.text for r in M.read_versions(spark, str(tmp_path / "out")).collect()}
    assert rows == {"a": "2", "b": "1"}


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "e")
    spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 3.0), ("2024-01-01 01:00:00", 5.0)], "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value").write.parquet(src)
    events = M.file_stream(spark, src, "ts timestamp, value double")
    M.windowed_metrics(events).writeStream.outputMode("complete").format("memory").queryName("wm").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT n FROM wm").collect()) == [1, 2]


def test_inverted_file_recall(spark):
    from lodestone.operators import ann

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.4, size=(4000, 16))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0])], "id long, vector array<double>").cache()
    cells = ann.Cells.fit(points.where("id < 9000"), 32)
    indexed = cells.index(points).cache()
    assert indexed.count() == 4002 and indexed.where("cell is null").count() == 2
    shares = []
    for i in range(0, 4000, 500):
        exact = S.vector_search(points, x[i].tolist(), 10)
        shares.append(ann.recall(cells.search(indexed, x[i].tolist(), 10, probes=6), exact))
    assert sum(shares) / len(shares) >= 0.9
    assert ann.Cells.fit(points.limit(0), 4).search(indexed, x[0].tolist()).count() == 0


def test_triplets_and_kinds(spark):
    from lodestone.functions.filters import field_kinds, tags_equal

    text = "<s><triplet> Ann <subj> works for <obj> Acme <triplet> x <subj> <obj> y <triplet>a<subj>b<obj>c</s>"
    df = spark.createDataFrame([(text, ["B", "a"]), (None, None), ("plain", ["a"])], "t string, tags array<string>")
    assert [[tuple(x) for x in r.x] if r.x is not None else None for r in df.select(X.triplets(F.col("t")).alias("x")).collect()] == [[("Ann", "works for", "Acme"), ("a", "b", "c")], None, []]
    assert [r.e for r in df.select(tags_equal(F.col("tags"), ["A", "b"]).alias("e")).collect()] == [True, None, False]
    kinds = field_kinds(spark.createDataFrame([], "n int, s string, t array<string>, g struct<lat double, lon double>, o struct<p struct<q date>, b boolean>").schema)
    assert kinds == {"n": "numeric", "s": "string", "t": "tags", "g": "geo", "o": "nested", "o.p": "nested", "o.p.q": "time", "o.b": "boolean"}


def test_document_catalogue(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz"), (2, "# D\nw")], "doc_id int, text string")
    nodes = D.sections(docs)
    assert {(r.doc_id, r.n_nodes, r.n_top) for r in D.catalogue(nodes).collect()} == {(1, 3, 2), (2, 1, 1)}
    assert D.exists(nodes, 2) and not D.exists(D.delete(nodes, docs.where("doc_id = 2")), 2)
    top = nodes.where("title = 'A'")
    assert [r.title for r in D.children(nodes, top).collect()] == ["B"]
