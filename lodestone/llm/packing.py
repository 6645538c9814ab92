"""Packing (operator 1): cutting-stock column generation over a length histogram.

Every document becomes its token ids and the end id; longer ones are cut at multiples of the sequence length.
The lengths of all pieces make a histogram of at most `size` entries, whatever the corpus holds. On it a
linear program over patterns (multisets of length classes that fit a sequence) is solved by column generation:
a knapsack dynamic program prices new patterns, a product-form inverse keeps the basis. Patterns are rounded
down; what is left (at most a few pieces per pattern of the basis) is packed best-fit decreasing. Pieces are
ranked within their length, and (length, rank) addresses a sequence and an offset through the pattern table,
whose size depends on `size` alone.

Defined cases: null text is an empty text, whose document is the end id alone; each row is a document, rows
with repeated or null ids included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shuffle_partitions, tidy

#: Width of a length class in tokens: classes round lengths up to a multiple of it.
GRAIN = 8
#: The linear program stops within this share of its lower bound.
GAP = 5e-4
#: Share of the best prices so far in the prices of a round; the rest are the current ones.
PULL = 0.8
#: Pieces that one ranking group should hold at most, on average.
RANK_GROUP = 100_000


# ---------------------------------------------------------------- token ids
class IdEncoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them, by the faster tiktoken merges."""

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        from lodestone.llm.token_counts import PieceCounter, byte_characters

        spec = json.load(open(path, encoding="utf-8"))
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE files are supported")
        back = {c: b for b, c in byte_characters().items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PieceCounter.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def __call__(self, text: str) -> np.ndarray:
        if self.cutter is not None and any(s in text for s in self.special):
            parts = [[self.special[x]] if i % 2 else self.encoding.encode_ordinary(x) for i, x in enumerate(self.cutter.split(text))]
            return np.array([i for p in parts for i in p], np.uint32)
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


_PIECES = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("salt", pa.int64())])


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """Cut documents into pieces of at most size ids: id, start, length, ids_crc32, doc_tokens, salt (0 to 2**20; by
    row, so that equal texts get many salts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        encode, end = encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                for start in range(0, len(ids), size):
                    body = ids[start : start + size].tobytes()
                    crc = zlib.crc32(body)
                    rows.append((key, start, len(body) // 4, crc, len(ids), zlib.crc32(b"%d-%d" % (part, serial), crc) >> 12))
                    serial += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=_PIECES)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "id long, start long, length long, ids_crc32 long, doc_tokens long, salt long")


# ---------------------------------------------------------------- linear program
def knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best multiset of classes 1..capacity for the given values: its worth, and its counts."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = values[1 : c + 1] + best[c - 1 :: -1] if c > 1 else values[1:2] + best[:1]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], choice[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    counts: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c]:
            counts[int(choice[c])] = counts.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(best[capacity]), counts


def column_generation(demand: dict[int, int], capacity: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Fractional cutting-stock solution: (pattern of classes, its number of sequences).

    demand: pieces of each class (1..capacity). Each pattern fits capacity; together they cover demand.
    """
    classes = sorted(demand, reverse=True)
    if not classes:
        return []
    m, need = len(classes), np.array([demand[c] for c in classes], float)
    position = {c: i for i, c in enumerate(classes)}
    columns: list[dict[int, int]] = [{c: capacity // c} for c in classes]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (capacity // c) for c in classes])
    x = inverse @ need
    centre, bound = np.array(classes) / capacity, 0.0  # prices by size are the first guess at the dual
    for _ in range(40 * m + 200):
        out = cost @ inverse
        pattern: dict[int, int] | None = None
        a = np.zeros(m)
        if out.min() < -1e-9:  # more of that class than is asked for: its surplus enters, without cost
            pattern = {}
            a[int(out.argmin())] = -1.0
        weight = PULL
        while pattern is None:
            prices = np.maximum(weight * centre + (1 - weight) * out, 0)
            values = np.full(capacity + 1, -1.0)
            values[classes] = prices
            worth, found = knapsack(values, capacity)
            if (lower := float(prices @ need) / max(worth, 1e-9)) > bound:  # Farley's bound
                bound, centre = lower, prices / max(worth, 1e-9)
            if sum(out[position[c]] * k for c, k in found.items()) > 1 + 1e-9:
                pattern = found
                for c, k in found.items():
                    a[position[c]] = k
            elif weight == 0:
                break
            else:
                weight = weight / 3 if weight > 0.05 else 0.0
        if pattern is None or cost @ x - bound <= gap * (cost @ x):
            break
        d = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(d > 1e-9, np.maximum(x, 0) / d, np.inf)
        r = int(ratios.argmin())
        if not np.isfinite(ratios[r]):
            break
        step = ratios[r]
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        x -= d * step
        x[r] = step
        columns[r], cost[r] = pattern, float(bool(pattern))
    return [(p, float(v)) for p, v in zip(columns, x) if p and v > 0]


@dataclass
class Slots:
    """Where the pieces of each length go: sorted arrays by (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(histogram: dict[int, int], size: int, grain: int = GRAIN) -> tuple[Slots, int]:
    """Slots for all pieces of a length histogram, and the number of sequences."""
    left = dict(histogram)
    used: dict[int, int] = {}
    rows: list[tuple[int, int, int, int]] = []
    n_sequences = 0

    def put(items: list[int], times: int) -> None:
        nonlocal n_sequences
        at = 0
        for length in items:
            rows.append((length, used.get(length, 0), n_sequences, at))
            used[length] = used.get(length, 0) + times
            left[length] -= times
            at += length
        n_sequences += times

    if left.get(size):
        put([size], left[size])
    of = lambda length: -(-length // grain)
    demand: dict[int, int] = {}
    for length, n in left.items():
        if n and length < size:
            demand[of(length)] = demand.get(of(length), 0) + n
    members: dict[int, list[int]] = {}
    for length in sorted(histogram, reverse=True):
        if length < size:
            members.setdefault(of(length), []).append(length)
    for pattern, amount in column_generation(demand, size // grain):
        times = int(amount + 1e-9)
        classes = [c for c, k in sorted(pattern.items(), reverse=True) for _ in range(k)]
        # a class holds up to `grain` lengths: take the longest that is left, as often as all slots allow
        while times > 0:
            taken: dict[int, int] = {}
            items = []
            for c in classes:
                pick = next((x for x in members.get(c, ()) if left[x] - taken.get(x, 0) > 0), None)
                if pick is not None:
                    items.append(pick)
                    taken[pick] = taken.get(pick, 0) + 1
            if not items:
                break
            run = min(times, min(left[x] // k for x, k in taken.items()))
            put(items, run)
            times -= run
    rest = [x for x, n in sorted(left.items(), reverse=True) for _ in range(n)]
    free: list[tuple[int, list[int]]] = []
    import bisect

    for length in rest:  # best fit decreasing
        i = bisect.bisect_left(free, (length, []))
        room, items = free.pop(i) if i < len(free) else (size, [])
        bisect.insort(free, (room - length, [*items, length]))
    for _, items in free:
        put(items, 1)
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*table.T), n_sequences


# ---------------------------------------------------------------- operator
def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cutout = cut(pieces(docs, path, id_col, text_col, size, end_id))
    histogram = {r["length"]: r["count"] for r in cutout.groupBy("length").count().collect()}  # at most `size` rows
    slots, _ = plan(histogram, size)
    groups = max(1, -(-sum(histogram.values()) // RANK_GROUP), shuffle_partitions(spark))
    salted = cutout.withColumn("salt", F.col("salt") % groups)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("rank"))
    key = slots.length * (1 << 40) + slots.rank
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slots.sequence[i] + rank - slots.rank[i]), pa.array(slots.offset[i])], schema=out)

    placed = ranked.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
