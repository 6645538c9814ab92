"""Knowledge graphs: extraction by rules, merging, neighbourhoods, components, communities, retrieval.

Entities are (id, name, type, description, aliases, importance), edges (src, dst, type, strength, bidirectional).
"""

from __future__ import annotations

import difflib
import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vector as V
from lodestone.operators.search import rounded, top

# Parts of a name that decide its type, and names that are no entities.
ORGANIZATION_PARTS = ("inc", "corp", "ltd", "company", "co")
LOCATION_PARTS = ("city", "country", "state", "street")
NO_ENTITIES = ("the", "a", "an", "this", "that", "it", "he", "she", "they")


def persist(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder that spark.checkpoint.dir names, or by caching where there is none."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- extraction
def entity_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"


def extract_entities(units: DataFrame, unit_col: str = "unit", text_col: str = "text", shortest: int = 2, longest: int = 100) -> DataFrame:
    """(unit, position, name, type) of runs of capitalised words; position: characters before the run."""
    t = F.col(text_col)
    runs = F.regexp_extract_all(t, F.lit(NAME), F.lit(0))
    # between the runs stands what splitting leaves; lengths of both add up to the places of the runs
    parts = units.select(unit_col, F.monotonically_increasing_id().alias("__row"), F.arrays_zip(F.split(t, NAME, -1).alias("gap"), runs.alias("raw")).alias("z"))
    flat = parts.select(unit_col, "__row", F.posexplode("z").alias("i", "z")).select(unit_col, "__row", "i", "z.gap", "z.raw")
    before = Window.partitionBy("__row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("gap") + F.coalesce(F.length("raw"), F.lit(0))).over(before), F.lit(0)) + F.length("gap")
    names = flat.withColumn("position", at).where("raw is not null")
    name = F.regexp_replace("raw", r"\s+", " ")
    low = F.lower(name)
    organization = F.lit(False)
    for p in ORGANIZATION_PARTS:
        organization |= low.contains(p)
    location = F.lit(False)
    for p in LOCATION_PARTS:
        location |= low.contains(p)
    kind = F.when(organization, "ORGANIZATION").when(location, "LOCATION").otherwise("OTHER")
    valid = (F.length(name) >= shortest) & (F.length(name) <= longest) & ~low.isin(*NO_ENTITIES)
    return names.where(valid).select(unit_col, "position", name.alias("name"), kind.alias("type"))


def entity_ids(units: DataFrame, text_col: str = "text", shortest: int = 2, longest: int = 100) -> DataFrame:
    """(id): the entities of merge_entities(extract_entities(...)); runs are made distinct before they are looked at."""
    runs = units.select(F.explode_outer(F.regexp_extract_all(text_col, F.lit(NAME), F.lit(0))).alias("raw")).where("raw is not null")
    name = F.regexp_replace("raw", r"\s+", " ")
    valid = (F.length(name) >= shortest) & (F.length(name) <= longest) & ~F.lower(name).isin(*NO_ENTITIES)
    return persist(runs.distinct()).where(valid).select(entity_key(name).alias("id")).distinct()


def relation_type(a: Column, b: Column) -> Column:
    """The type of a relation between entities of two types."""

    def pair(x: str, y: str) -> Column:
        return ((a == x) & (b == y)) | ((a == y) & (b == x))

    return (
        F.when(pair("PERSON", "ORGANIZATION"), "works_for")
        .when(pair("PERSON", "LOCATION") | pair("ORGANIZATION", "LOCATION"), "located_in")
        .when(pair("ORGANIZATION", "PRODUCT"), "produces")
        .otherwise("related_to")
    )


def cooccurrence(mentions: DataFrame, window: float = 200, least: float = 0.3, unit_col: str = "unit") -> DataFrame:
    """Relations of different names within window positions of a unit; a pair's first meeting counts.

    Positions are cut into cells of the window's width, so a mention meets its own and the next cell only.
    """
    cells = mentions.select(unit_col, "position", "name", "type", F.floor(F.col("position") / window).cast("long").alias("cell"))
    a = cells.select(unit_col, F.col("position").alias("pa"), F.col("name").alias("na"), F.col("type").alias("ta"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    b = cells.select(unit_col, F.col("position").alias("pb"), F.col("name").alias("nb"), F.col("type").alias("tb"), "cell")
    near = a.join(b, [unit_col, "cell"]).where(F.col("pb").between(F.col("pa"), F.col("pa") + window) & (entity_key(F.col("na")) != entity_key(F.col("nb"))))
    ka, kb = entity_key(F.col("na")), entity_key(F.col("nb"))
    pairs = near.select(unit_col, F.least(ka, kb).alias("src"), F.greatest(ka, kb).alias("dst"), "pa", "pb", relation_type(F.col("ta"), F.col("tb")).alias("type"))
    first = Window.partitionBy(unit_col, "src", "dst").orderBy("pa", "pb", "type")
    chosen = pairs.withColumn("r", F.row_number().over(first)).where("r = 1")
    return chosen.select(unit_col, "src", "dst", "type", F.greatest(F.lit(least), 1 - (F.col("pb") - F.col("pa")) / window).alias("strength"))


def merge_entities(mentions: DataFrame, unit_col: str = "unit") -> DataFrame:
    """One row a normalised name: id, name, type, aliases, n_units, n_mentions."""
    key = entity_key(F.col("name"))
    return mentions.groupBy(key.alias("id")).agg(
        F.min("name").alias("name"), F.min("type").alias("type"), F.array_sort(F.collect_set("name")).alias("aliases"),
        F.countDistinct(unit_col).alias("n_units"), F.count("*").alias("n_mentions"),
    )


def merge_edges(relations: DataFrame, entities: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a (src, dst, type) with both ends known: mean strength over its sources, at most 1."""
    kept = relations.where(F.col("strength") >= least)
    for end in ("src", "dst"):
        kept = kept.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    return kept.groupBy("src", "dst", "type").agg(F.least(F.lit(1.0), rounded(F.avg("strength") + 1e-9)).alias("strength"), F.count("*").alias("n_sources"))


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with both ends replaced by ids (old, new) where they are listed."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("old").alias(end), F.col("new").alias(f"__{end}")), end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out


#: Kept subsequences of a name on average and of one name at most, longest names that are found by them, and
#: subsequences of a part.
VARIANTS = 200
MOST = 10_000
LONGEST = 60
PART = 300_000


def _alike(ratio: float):
    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = difflib.SequenceMatcher(None, "", ""), difflib.SequenceMatcher(None, "", "")
        out, last = [], None
        for x, y in zip(a, b):
            if x != last:
                one.set_seq2(x)
                last = x
            one.set_seq1(y)
            good = one.ratio() >= ratio
            if not good:
                two.set_seqs(x, y)
                good = two.ratio() >= ratio
            out.append(good)
        return pd.Series(out, dtype=bool)

    return alike


def _kept(n: int, ratio: float) -> range:
    """How many characters a name of n can have in common with another that reaches the ratio: the other has no fewer."""
    return range(max(1, math.ceil(n * ratio / (2 - ratio) - 1e-9)), n + 1)


@functools.lru_cache(64)
def _places(n: int, kept: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), kept)), np.int8)


def _subsequences(ratio: float, parts: int):
    """(part, keys, ids, sizes): hashes of the subsequences that names keep, dealt to parts. A key's last six bits are the
    subsequence's length; the first bit of a size is the name's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, ids, size = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = ((key >> np.uint64(6)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, ids, size, part = key[order], ids[order], size[order], part[order]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(part))
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist())], pa.binary()) for x in (key, ids, size)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), *blobs], names=["part", "keys", "ids", "sizes"])

        for batch in batches:
            names, n = batch.column("name").to_pylist(), batch.column("n").to_numpy()
            number, marked = batch.column("id").to_numpy(), batch.column("marked").to_numpy(zero_copy_only=False)
            for size in np.unique(n).tolist():
                lengths = _kept(size, ratio)
                rows = np.flatnonzero(n == size)
                step = max(1, (1 << 20) // sum(math.comb(size, k) for k in lengths))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    text = np.frombuffer("".join(names[i] for i in some.tolist()).encode("utf-32-le"), np.uint32).reshape(len(some), size).astype(np.uint64)
                    marks = (size | marked[some].astype(np.uint8) << 7).astype(np.uint8)
                    for kept in lengths:
                        places = _places(size, kept)
                        h = np.zeros((len(some), len(places)), np.uint64)
                        for i in places.T:
                            h += text[:, i] + np.uint64(1)
                            h *= np.uint64(0xD1342543DE82EF95)
                            h ^= h >> np.uint64(29)
                        held.append(((h << np.uint64(6) | np.uint64(kept)).ravel(), np.repeat(number[some], len(places)), np.repeat(marks, len(places))))
                    if sum(len(h[0]) for h in held) >= 1 << 20:
                        yield from flush()
        if held:
            yield from flush()

    return run


def _meetings(ratio: float, every: bool):
    """(a, b): ids of names that keep the same subsequence, long enough for both: the shortest name with each other one,
    or with every also each marked name with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[tuple[bytes, bytes, bytes]] = []
        for batch in batches:
            blobs += zip(*(batch.column(c).to_pylist() for c in ("keys", "ids", "sizes")))
        if not blobs:
            return
        key, ids, size = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*blobs), (np.uint64, np.int64, np.uint8)))
        blobs.clear()
        n = (size & 127).astype(np.int64)
        order = np.lexsort((ids, n, key))
        key, ids, n, marked = key[order], ids[order], n[order], size[order] > 127
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids, n, marked = key[new], ids[new], n[new], marked[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        if every:
            x = np.flatnonzero(marked)
            group = np.searchsorted(start, x, side="right") - 1
            first, many = start[group], count[group]
        else:
            x = start[count > 1]
            first, many = x, count[count > 1]
        step = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + (1 << 20), 1 << 20))
        for lo, hi in zip(step, step[1:]):
            m, at = many[lo : hi + 1], first[lo : hi + 1]
            if not len(m):
                continue
            a = np.repeat(x[lo : hi + 1], m)
            b = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at, m)
            good = (a != b) & (ratio * (n[a] + n[b]) <= 2 * (key[a] & np.uint64(63)).astype(np.int64) + 1e-9)
            both = np.unique(np.stack([ids[a[good]], ids[b[good]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _common_grams(named: DataFrame, ratio: float, limit: int) -> DataFrame:
    """(a, b): ids of names, one longer than limit, that share one of their rarest runs of two or three characters.

    M characters in common, in at most n + m - 2 M + 1 blocks, leave M - (q - 1) (n + m - 2 M + 1) common runs of q, so
    one of those stands among the rarest of each name: as many as it can spare, and one.
    """
    n = F.col("n")
    least = F.ceil(n * ratio / (2 - ratio) - 1e-9)
    lowest = max(2, math.ceil((limit + 1) * ratio / (2 - ratio) - 1e-9))
    q = 3 if (2.5 * ratio - 2) * (limit + 1 + lowest) > 2 else 2
    total = n + F.when(n > limit, least).otherwise(F.greatest(least, F.lit(limit + 1)))
    shared = F.greatest(F.lit(1), F.ceil(total * ((q - 0.5) * ratio - (q - 1)) - (q - 1) - 1e-9))
    grams = named.where(n >= lowest).select("id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(F.col("name"), i, F.lit(q)))).alias("i", "g"))
    times = F.row_number().over(Window.partitionBy("id", "g").orderBy("i"))
    grams = persist(grams.select("id", "n", F.concat("g", times.cast("string")).alias("g")))
    often = grams.groupBy("g").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "g"))
    rare = persist(grams.join(often, "g").withColumn("place", place).where(F.col("place") <= n - q + 1 - shared + 1).select("id", "n", "g"))
    a = rare.where(n > limit).select("g", F.col("id").alias("a"), F.col("n").alias("an"))
    b = rare.select("g", F.col("id").alias("b"), F.col("n").alias("bn"))
    near = a.join(b, "g").where((F.col("bn") <= limit) | (F.col("a") < F.col("b"))).where(2 * F.least("an", "bn") >= ratio * (F.col("an") + F.col("bn")) - 1e-9).select("a", "b").distinct()
    x, y = named.select(F.col("id").alias("a"), F.col("name").alias("x")), named.select(F.col("id").alias("b"), F.col("name").alias("y"))
    # M characters in common order leave at most n + m - 2 M to insert and delete
    return near.join(x, "a").join(y, "b").where(F.levenshtein("x", "y") <= F.floor((1 - ratio) * (F.length("x") + F.length("y")) + 1e-9)).select("a", "b")


def resolve_names(entities: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(old, new): names whose matching blocks hold as great a share of both as ratio (at least 0.75), mapped to the
    smallest id of their component. A pair counts if either order of it reaches the ratio.

    Candidates are exact. Names of lengths n and m that reach the ratio have M >= ratio * (n + m) / 2 characters in
    common order: they keep the same subsequence of M characters. Names meet by all subsequences that they can keep, as
    long as these are at most VARIANTS a name; longer names by rare runs of characters (_common_grams). Of names that
    keep the same one, each is compared with the shortest; where that fails, with all of them. So every pair that
    reaches the ratio is compared, or both of it are linked with a third.
    """
    if ratio < 0.75:
        raise ValueError("ratios below 0.75 leave no common pair of characters to find names by")
    spark = entities.sparkSession
    named = entities.select(F.col("id").alias("name")).distinct().withColumn("n", F.length("name")).where("n > 1")
    named = persist(named.withColumn("id", F.monotonically_increasing_id()))
    total, keys, limit, lengths = 0, 0, 1, {r.n: r["count"] for r in named.groupBy("n").count().collect()}
    everyone = sum(lengths.values())
    for n in range(2, min(LONGEST, max(lengths, default=0)) + 1):
        each = sum(math.comb(n, k) for k in _kept(n, ratio))
        total += lengths.get(n, 0) * each
        if total > VARIANTS * everyone or each > MOST:
            break
        keys, limit = total, n
    parts = keys // PART + 1

    def meet(names: DataFrame, every: bool) -> DataFrame:
        short = names.where(F.col("n") <= limit).select("id", "name", "n", "marked").repartition(spark.sparkContext.defaultParallelism)
        dealt = short.mapInArrow(_subsequences(ratio, parts), "part int, keys binary, ids binary, sizes binary")
        return dealt.repartition(parts, "part").mapInArrow(_meetings(ratio, every), "a long, b long").distinct()

    def compare(pairs: DataFrame) -> DataFrame:
        x, y = named.select(F.col("id").alias("a"), F.col("name").alias("x")), named.select(F.col("id").alias("b"), F.col("name").alias("y"))
        dealt = pairs.join(x, "a").join(y, "b").repartition(max(parts, 4 * spark.sparkContext.defaultParallelism), "x")
        return persist(dealt.sortWithinPartitions("x").select("a", "b", _alike(ratio)("x", "y").alias("alike")))

    checked = compare(meet(named.withColumn("marked", F.lit(False)), False))
    links = checked.where("alike").select("a", "b")
    failed = persist(checked.where("not alike").select(F.col("b").alias("id")).distinct())
    if not failed.isEmpty():
        marked = named.join(failed.withColumn("m", F.lit(True)), "id", "left").withColumn("marked", F.coalesce("m", F.lit(False)))
        links = links.unionByName(compare(meet(marked, True)).where("alike").select("a", "b"))
    if limit < max(lengths, default=0):
        links = links.unionByName(compare(_common_grams(named, ratio, limit)).where("alike").select("a", "b"))
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).join(named.select(F.col("id").alias("node"), "name"), "node")
    found = persist(found)
    least = found.groupBy("component").agg(F.min("name").alias("new"))
    return found.join(least, "component").select(F.col("name").alias("old"), "new")


# ---------------------------------------------------------------- traversal
def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1, known: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes within depth steps of starts (node), each at its least distance; starts at 0."""
    first = starts.select("node").distinct()
    if known is not None:
        first = first.join(known.select(F.col("id").alias("node")), "node", "left_semi")
    seen = persist(first.withColumn("depth", F.lit(0)))
    if depth < 1:
        return seen
    steps, frontier = edges.select("src", "dst").where("src <> dst"), seen
    if depth > 1:
        steps = persist(steps)
    for d in range(1, depth + 1):
        # only edges at the frontier, from either end
        ends = [steps.join(frontier.select(F.col("node").alias(a)), a, "left_semi").select(F.col(b).alias("node")) for a, b in (("src", "dst"), ("dst", "src"))]
        reached = ends[0].union(ends[1]).distinct()
        frontier = persist(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of starts, and the edges among them."""
    nodes = neighbours(edges, starts, depth)
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return nodes, inside


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by min-label spreading with pointer jumps."""
    steps = persist(both_ways(edges))
    labels = persist(steps.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = steps.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = lower.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        following = persist(lower.join(jump, F.col("component") == F.col("j"), "left").select("node", F.least("component", F.coalesce("jc", "component")).alias("component")))
        changed = not following.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = following
        if not changed:
            break
    return labels


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(level, node, community): a hierarchy of communities by greedy modularity. On a level every node may move to the
    neighbouring community of greatest gain; half of the nodes (by hash) move at a time, so that neighbours do not
    swap places for ever. A level ends when modularity no longer grows; its communities are the nodes of the next,
    until nothing merges. Communities are named by their smallest node; edges are (src, dst, strength).
    """
    w = edges.select("src", "dst", "strength").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))
    w = persist(w.groupBy("src", "dst").agg(F.sum("strength").cast("double").alias("w")))
    total = w.agg(F.sum("w")).first()[0]
    home = w.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    out, level = None, 0
    while total:
        labels, moved = _local_moves(w, total, resolution)
        if out is not None and not moved:
            break
        least = labels.groupBy("community").agg(F.min("node").alias("name"))
        labels = labels.join(least, "community").select("node", F.col("name").alias("community"))
        named = labels.select(F.col("node").alias("community"), F.col("community").alias("next"))
        home = persist(home.join(named, "community").select("node", F.col("next").alias("community")))
        part = home.select(F.lit(level).alias("level"), "node", "community")
        out, level = part if out is None else out.unionAll(part), level + 1
        if not moved:
            break
        ends = labels.select(F.col("node").alias("src"), F.col("community").alias("s")), labels.select(F.col("node").alias("dst"), F.col("community").alias("d"))
        w = persist(w.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")))
    return out if out is not None else home.select(F.lit(0).alias("level"), "node", "community")


def _local_moves(w: DataFrame, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """(node, community) after moves that raise modularity, and whether any did."""
    degree = persist(w.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    labels = degree.select("node", "k", F.col("node").alias("community"))

    def modularity(labels: DataFrame) -> float:
        ends = labels.select(F.col("node").alias("src"), F.col("community").alias("s")), labels.select(F.col("node").alias("dst"), F.col("community").alias("d"))
        inside = w.join(ends[0], "src").join(ends[1], "dst").where("s = d").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        sizes = labels.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        return inside / total - resolution * sizes / total**2

    best, reached, idle, turn = labels, modularity(labels), 0, 0
    while idle < 4:  # both halves, twice
        tot = labels.groupBy("community").agg(F.sum("k").alias("t"))
        into = w.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("into"))
        own = labels.select("node", "k", F.col("community").alias("own"))
        stay = labels.select("node", "community", F.lit(0.0).alias("into"))
        options = into.unionByName(stay).groupBy("node", "community").agg(F.sum("into").alias("into")).join(tot, "community").join(own, "node")
        here = F.col("community") == F.col("own")
        gain = F.round(F.col("into") - resolution * F.col("k") * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
        order = Window.partitionBy("node").orderBy(F.desc("gain"), F.desc("here"), "community")
        pick = options.withColumn("gain", gain).withColumn("here", here).withColumn("r", F.row_number().over(order)).where("r = 1")
        free = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        labels = persist(pick.select("node", "k", F.when(free, F.col("community")).otherwise(F.col("own")).alias("community")))
        now, turn = modularity(labels), turn + 1
        idle = 0 if now > reached + 1e-9 else idle + 1
        if now > reached + 1e-9:
            best, reached = labels, now
    return best.select("node", "community"), best is not degree and not best.where("node <> community").isEmpty()


def importance(edges: DataFrame) -> DataFrame:
    """(node, importance): edges at a node over the largest such number; a loop counts once."""
    keyed = edges.withColumn("__e", F.monotonically_increasing_id()) if "id" not in edges.columns else edges.withColumn("__e", F.col("id"))
    ends = keyed.select(F.col("src").alias("node"), "__e").union(keyed.where("src <> dst").select(F.col("dst").alias("node"), "__e"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return degree.crossJoin(F.broadcast(degree.agg(F.max("degree").alias("most")))).select("node", "degree", rounded(F.col("degree") / F.col("most")).alias("importance"))


def community_summaries(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(community, size, summary): size, types and first names of each community."""
    joined = members.join(entities.select(F.col("id").alias("node"), "name", "type"), "node")
    by = Window.partitionBy("community").orderBy("node")
    shown = joined.withColumn("r", F.row_number().over(by))
    out = shown.groupBy("community").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_set(F.when(F.col("r") <= 10, F.col("type")))).alias("types"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "name")))).alias("names")
    )
    text = F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" entities ("), F.array_join("types", ", "), F.lit("): "), F.array_join(F.transform("names", lambda x: x["name"]), ", "))
    return out.select("community", "size", text.alias("summary"))


# ---------------------------------------------------------------- retrieval
def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def seeds(entities: DataFrame, query: str, k: int = 10, query_vector=None) -> DataFrame:
    """Entities whose name, words or aliases meet the query, best first: id, score."""
    q = query.lower()
    words = F.array(*[F.lit(w) for w in sorted(set(q.split()))]).cast("array<string>")
    name = F.lower("name")
    shared = F.size(F.array_intersect(_words(F.col("name")), words))
    text = F.when(F.lit(q).contains(name) | name.contains(q), 1.0)
    text = text.when(shared > 0, 0.8 * shared / F.greatest(F.size(words), F.size(_words(F.col("name")))))
    if "aliases" in entities.columns:
        text = text.when(F.exists("aliases", lambda a: F.lit(q).contains(F.lower(a))), 0.9)
    score = text
    if query_vector is not None:
        sim = V.cosine_similarity("vector", query_vector)
        score = F.when(text.isNotNull(), F.least(F.lit(1.0), text + 0.3 * F.coalesce(sim, F.lit(0.0)))).otherwise(0.7 * sim)
    return top(entities.withColumn("score", score).where(F.col("score").isNotNull()), k).select("id", "score")


def local_search(entities: DataFrame, edges: DataFrame, query: str, k: int = 10, depth: int = 2, query_vector=None) -> DataFrame:
    """Entities around the seeds: 0.4 of the seed score, or 0.3 / (1 + distance), and description words, importance
    and vector similarity."""
    found = persist(seeds(entities, query, 2 * k, query_vector))
    around = neighbours(edges, found.select(F.col("id").alias("node")), depth)
    joined = entities.join(around.withColumnRenamed("node", "id"), "id").join(found.withColumnRenamed("score", "seed"), "id", "left")
    words = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))]).cast("array<string>")
    score = F.when(F.col("seed").isNotNull(), 0.4 * F.col("seed")).otherwise(0.3 / (1 + F.col("depth")))
    if "description" in entities.columns:
        score = score + 0.1 * F.coalesce(F.size(F.array_intersect(_words(F.col("description")), words)), F.lit(0))
    if "importance" in entities.columns:
        score = score + 0.2 * F.coalesce(F.col("importance"), F.lit(0.0))
    if query_vector is not None:
        score = score + 0.3 * F.coalesce(V.cosine_similarity("vector", query_vector), F.lit(0.0))
    return top(joined.withColumn("score", score), k).select("id", "score")


def local_edges(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges with both ends among the hits, strongest first."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(hits.select(F.col("id").alias(end)), end, "left_semi")
    return out.orderBy(F.desc("strength"), "src", "dst")


def global_search(communities: DataFrame, query: str, k: int = 5, level_weight: Column | None = None, query_vector=None) -> DataFrame:
    """Communities (id, summary, size, importance) by summary words, importance and size."""
    words = sorted(set(query.lower().split()))
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    summary = F.coalesce("summary", F.lit(""))
    score = 0.4 * F.size(F.array_intersect(_words(summary), listed)) / max(len(words), 1)
    score = score + 0.1 * F.size(F.filter(listed, lambda w: F.contains(F.lower(summary), w)))
    score = score + 0.2 * F.coalesce(F.col("importance"), F.lit(0.0)) + 0.1 * F.least(F.lit(1.0), F.col("size") / 20)
    if level_weight is not None:
        score = score * level_weight
    if query_vector is not None:
        score = score + 0.3 * F.coalesce(V.cosine_similarity("vector", query_vector), F.lit(0.0))
    return top(communities.withColumn("score", score), k)


def fuse_local_global(local: DataFrame, global_ids: DataFrame, k: int = 10, local_weight: float = 0.6, global_weight: float = 0.4) -> DataFrame:
    """Local scores times their weight, plus the global weight where both found an id, or half of it."""
    total = local_weight + global_weight
    a, b = local_weight / total, global_weight / total
    joined = local.select("id", F.col("score").alias("s")).join(global_ids.select("id", F.lit(True).alias("g")).distinct(), "id", "full_outer")
    score = F.when(F.col("s").isNull(), 0.5 * b).when(F.col("g").isNull(), a * F.col("s")).otherwise(a * F.col("s") + b)
    return top(joined.withColumn("score", score), k).select("id", "score")


# Patterns of questions about one thing, about everything, and about connections.
SPECIFIC = (
    r"\bwho\s+is\b", r"\bwhat\s+is\b", r"\bwhen\s+did\b", r"\bwhere\s+is\b", r"\bhow\s+did\b", r"\bdefine\b",
    r"\bexplain\b.*\bspecific\b", r"\bdetails?\s+(about|of|on)\b",
)
BROAD = (
    r"\bwhat\s+are\s+the\s+(main|key|major|important)\b", r"\bsummarize\b", r"\boverview\b", r"\bthemes?\b", r"\btopics?\b",
    r"\bgenerally\b", r"\boverall\b", r"\bbroad\b", r"\bhigh.?level\b",
)
CONNECTED = (
    r"\bhow\s+(is|are|does|do)\s+.+\s+(related|connected|linked)\b", r"\brelationship\s+between\b", r"\bconnection\s+between\b",
    r"\bcompare\b", r"\bdifference\s+between\b",
)


def classify(query: Column) -> Column:
    """relationship, specific, broad or mixed: any pattern of connections decides; else the greater number of patterns,
    with one more for two capitalised words, half for at most five words (specific) or more than ten (broad)."""
    low = F.lower(query)
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")

    def hits(patterns: tuple[str, ...]) -> Column:
        total = F.lit(0.0)
        for p in patterns:
            total = total + low.rlike(p).cast("double")
        return total

    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}.")))
    specific = hits(SPECIFIC) + (capitals >= 2).cast("double") + 0.5 * (F.size(words) <= 5).cast("double")
    broad = hits(BROAD) + 0.5 * (F.size(words) > 10).cast("double")
    return F.when(hits(CONNECTED) > 0, "relationship").when(specific > broad, "specific").when(broad > specific, "broad").otherwise("mixed")


def classify_query(query: str) -> str:
    """classify() of one question."""
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(classify(F.lit(query)).alias("kind")).first().kind


def build(units: DataFrame, unit_col: str = "unit", text_col: str = "text", window: float = 200, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of text units: extraction, merging by normalised name, relations of at least `least`."""
    mentions = extract_entities(units, unit_col, text_col)
    entities = merge_entities(mentions, unit_col)
    return entities, merge_edges(cooccurrence(mentions, window, least, unit_col), entities, least)
