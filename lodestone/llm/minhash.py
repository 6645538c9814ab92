"""MinHash near-duplicates (operator 3).

1. A pass over the texts makes, per document, the number of its distinct word shingles, a digest of the set, the
   minima of many universal hashes, kept as one byte each, and a key for each band of minima. Documents with equal
   sets are one node (smallest id).
2. Bands give buckets. Every member of a bucket is compared with the bucket's pivot, never with all others: the
   member that shares buckets with most others, which is the original of a group of near copies where that is
   present. Signatures that are too far apart are dropped first, and full shingle sets confirm what is left.
3. Connected components by alternating large-star and small-star. In buckets that still hold several
   components, members outside the pivot's are joined exactly with all members of such buckets: in one order of
   their shingles, rarest first, two linked sets share one among their first (1 - threshold) of shingles, at places
   that leave enough behind them for the overlap. No link between candidates is lost, and common shingles of a
   large group make no pairs.
4. Components go back to all documents through the digest.

The chance that a pair at the threshold shares no band is at most MISS.

Defined cases: null text, no text or no words: an empty set, linked with nothing; fewer words than the width:
the whole sequence is one shingle; rows with equal ids are one document for linking and keep their own rows;
rows without an id are linked with nothing (component_id null, kept true); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, cut, drop, mix, tidy, utf8, words
from lodestone.llm.components import components

#: Largest chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-6
#: Most hash minima of a signature.
HASHES = 200
#: Standard deviations below the threshold at which a signature rules a pair out.
SIGMAS = 6


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands for a similarity of percent / 100: most rows within HASHES at a chance of MISS."""
    best = (1, HASHES)
    for rows in range(1, 13):
        bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
        if rows * bands <= HASHES:
            best = (rows, bands)
    return best


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of n multiply-add hashes modulo 2**32."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    _, _, h, at = words(data, offsets)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(width):
        rolled += h[j : j + n] * factor[j] if n > 0 else rolled
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(at.tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            short = (h[lo:hi] * factor[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """id, n_shingles, digest, keys (one a band), sig (a byte of each minimum); the last three null for empty sets."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])
    hashes = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = universal(hashes)
        factor = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        band = np.arange(bands, dtype=np.uint64) << np.uint64(40)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                minima = np.zeros((len(full), hashes), np.uint32)
                if len(full):
                    x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(hashes):
                        minima[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
                keys = mix((minima.reshape(-1, bands, rows).astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64) + band).view(np.int64)
                ends = np.cumsum(sizes > 0) * bands
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.ravel()))
                low, at = minima.astype(np.uint8), iter(range(len(full)))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [low[next(at)].tobytes() if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(sizes), pa.array(digests, pa.binary()), lists, pa.array(sigs, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(run), "id long, n_shingles long, digest binary, keys array<long>, sig binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Links documents whose shingle sets share at least percent / 100 of their union.
    """
    spark = docs.sparkSession
    rows, bands = banding(percent)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    files: list[str] = []
    base = cut(signatures(picked, width, rows, bands), files)
    nodes = base.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("node"), F.first("n_shingles").cast("int").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")
    )
    nodes = cut(nodes, files)  # equal sets have equal keys and signatures

    def near(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    exploded = nodes.select("node", "n", F.explode("keys").alias("k"))
    shared = exploded.groupBy("k").agg(F.count("*").alias("members")).where("members > 1")
    crowd = cut(exploded.join(shared, "k"), files)
    central = crowd.groupBy("node").agg(F.sum("members").alias("c"))
    crowd = cut(crowd.join(central, "node"), files)
    rank = F.struct("c", F.xxhash64("node").alias("o"), "node", "n")
    pivots = crowd.groupBy("k").agg(F.max(rank).alias("p")).select("k", F.col("p.node").alias("a"), F.col("p.n").alias("pn"))
    tried = crowd.join(pivots, "k").where("node <> a").where(near("n", "pn")).select("a", F.col("node").alias("b")).distinct()
    alike = cut(_alike(tried, nodes, rows * bands, percent), files)
    wanted = cut(alike.select(F.explode(F.array("a", "b")).alias("id")).distinct(), files)
    sets = cut(_sets(picked.join(wanted, "id", "left_semi"), width), files)
    comps = components(_confirmed(alike, sets, percent), files)

    # members of buckets with several components: comp, and whether they are outside the pivot's in any of these
    where = crowd.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    home = F.max(F.struct("c", F.xxhash64("node").alias("o"), "node", "comp"))["comp"]
    mixed = where.groupBy("k").agg(home.alias("home"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2")
    left = where.join(mixed.select("k", "home"), "k").groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("home")).alias("stray"))
    left = cut(left, files)
    if not left.isEmpty():
        # linked sets share one of their rarest shingles, early enough to reach the overlap
        more = _sets(picked.join(left.join(wanted, left["node"] == wanted["id"], "left_anti").select(F.col("node").alias("id")), "id", "left_semi"), width)
        members = cut(sets.join(left, "node", "left_semi").unionAll(more), files)
        ranked = _ranked(members).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
        heads = cut(ranked.join(left.select("node", "comp", "stray"), "node"), files)
        outside = heads.where("stray").select("h", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("comp").alias("bc"))
        others = heads.select("h", F.col("node").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("comp").alias("ac"), F.col("stray").alias("also"))
        reach = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) * (100 + percent) >= (F.col("an") + F.col("bn")) * percent
        once = ~F.col("also") | (F.col("a") < F.col("b"))
        rest = outside.join(others, "h").where("ac <> bc").where(once).where(near("an", "bn")).where(reach).select("a", "b").distinct()
        found = cut(_confirmed(_alike(rest, nodes, rows * bands, percent), members, percent), files)
        if not found.isEmpty():
            comps = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found), files)
    of = nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = base.select("id", "n_shingles", "digest").join(of, "digest", "left")
    out = out.withColumn("component_id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id")))
    out = cut(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))
    drop(spark, files)
    return out


def _ranked(sets: DataFrame) -> DataFrame:
    """(node, h, pos, n): the shingles of every set, from those that the fewest sets hold to the commonest."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column("node").to_pylist(), batch.column("members")):
                hashes = np.frombuffer(blob.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), key)), pa.array(hashes), pa.array(np.full(len(hashes), len(hashes)))], names=["node", "h", "n"])

    flat = sets.mapInArrow(spread, "node long, h long, n long")
    often = flat.groupBy("h").agg(F.count("*").alias("f"))
    # n as well: an id that comes with several texts has several sets
    order = F.row_number().over(Window.partitionBy("node", "n").orderBy("f", "h"))
    return flat.join(often, "h").select("node", "h", (order - 1).alias("pos"), "n")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return texts.mapInArrow(tidy(run), "node long, members binary")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _alike(pairs: DataFrame, signed: DataFrame, hashes: int, percent: int) -> DataFrame:
    """Pairs whose signatures do not rule the threshold out. Bytes of different minima may agree, which only keeps a pair."""
    s = percent / 100
    least = math.floor(hashes * s - SIGMAS * math.sqrt(hashes * s * (1 - s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, hashes) for c in ("sa", "sb"))
                near = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], schema=_PAIR)

    joined = pairs.join(signed.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    joined = joined.join(signed.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v): pairs whose full shingle sets reach the threshold."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common) and common > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], schema=schema)

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
    return joined.select("a", "b", "ma", "mb").mapInArrow(tidy(run), "u long, v long")
