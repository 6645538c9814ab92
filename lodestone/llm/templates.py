"""Benchmark decontamination (operator 4): template windows with typed slots.

Texts become tokens: runs of letters (of any script, with their marks) in lower case, each ideograph or kana by itself, with typed
placeholders for numbers, for units after numbers and for names (capitalised words that do not begin a sentence). Windows of WINDOW tokens are hashed over the
placeholders, so that a question with other numbers, units or names keeps its windows. Windows of documents
meet windows of benchmark items in a hash join. Matches on one diagonal (position in the document less position
in the item) must map each slot value of the item to one value of the document; diagonals that do not are no
evidence. Every window is also hashed over its words, numbers, units and names as they stand (verbatim windows).
A document is linked with an item if consistent windows, or verbatim ones, cover at least COVER of the item's
windows of that sort, or if RUN consecutive words stand in both. The counts and the share that are returned are
those of windows with slots where these link, else those of verbatim windows.

The benchmark's distinct window hashes filter the documents' windows before the join while they are at most
FILTER_WINDOWS (8 bytes each, broadcast); beyond that all windows are joined in a shuffle. The rows are the same.

Defined cases: null or empty texts have no windows; items shorter than a window are one window of their own
length; windows with fewer than LITERALS ordinary words (or all of them, if the item has fewer) are used verbatim
only; rows without an id take no part; rows with equal
ids are one document or item; repeated rows change nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, mix, powers, slices, tidy

#: Tokens of a window, ordinary words it needs, share of an item's windows that links a document.
WINDOW = 8
LITERALS = 4
COVER = 0.5
#: Consecutive words that link a document with an item whatever their share is.
RUN = 13
#: Most distinct window hashes of the benchmark that are broadcast as a filter.
FILTER_WINDOWS = 2_000_000

# Unit names that are placeholders after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw wh kwh v mv a ma ohm ohms j kj cal kcal n pa kpa bar psi "
    "c f k degree degrees percent pct usd eur gbp dollar dollars euro euros cent cents b kb mb gb tb mph kmh kph rpm"
).split()

#: What a code point is: part of a word, digit, a word by itself (ideographs, kana); and whether it is a capital or ends a sentence.
LETTER, DIGIT, ALONE, UPPER, STOP = 1, 2, 3, 8, 16
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (1, 2, 3))


@functools.lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower-case form of every code point."""
    bits, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            bits[code] = LETTER | (UPPER if kind in ("Lu", "Lt") else 0)
            low = c.lower()
            if len(low) == 1:
                lower[code] = ord(low)
        elif kind == "Nd":
            bits[code] = DIGIT
    for lo, hi in ((0x3041, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        bits[lo:hi] = np.where(bits[lo:hi] & 3 == LETTER, ALONE, bits[lo:hi])
    bits[[ord(c) for c in ".!?:;\n\u2026\u3002\uff01\uff1f"]] |= STOP
    return bits, lower


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one array of code points and n + 1 offsets; null counts as empty."""
    texts = [x or "" for x in column.to_pylist()]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _word_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, from code points in lower case."""
    up, down = powers(len(low) + 1)
    s = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(mix(low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=s[1:])
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64)) | np.uint64(8)


@functools.lru_cache(1)
def _unit_hashes() -> np.ndarray:
    data, _ = code_points(pa.array([" ".join(UNITS)]))
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(_word_hash(data, ends - np.array([len(u) for u in UNITS]), ends))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and codes of the tokens of texts (code points), n + 1 offsets of the texts' tokens, and hashes of
    the tokens in lower case. A code is 1, 2 or 3 for a number, unit or name, else that hash."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if not n:
        return empty, empty, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.uint64)
    bits, lower = classes()
    of = bits[data]
    kind = of & 3
    inner = np.zeros(n, bool)  # a point or comma between digits belongs to the number
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inner[1:] &= ~edge[1:n]
    inner[:-1] &= ~edge[1:n]
    kind[inner] = DIGIT
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:n] | (kind[1:] == ALONE)
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], n)
    solid = kind[begin] > 0
    starts, ends = begin[solid], stop[solid]
    at = np.searchsorted(starts, offsets)
    plain = _word_hash(lower[data], starts, ends)
    code = plain.copy()
    number = kind[starts] == DIGIT
    code[number] = _NUMBER
    if len(starts) > 1:
        first = np.zeros(len(starts) + 1, bool)
        first[at] = True
        follows = ~first[1 : len(starts)]
        unit = np.zeros(len(starts), bool)
        unit[1:] = follows & number[:-1] & ~number[1:] & np.isin(code[1:], _unit_hashes())
        stops = np.concatenate([[0], np.cumsum((of & STOP > 0) & ~inner)])
        name = np.zeros(len(starts), bool)
        name[1:] = follows & (of[starts[1:]] & UPPER > 0) & (stops[starts[1:]] == stops[ends[:-1]])
        code[name & ~number] = _NAME
        code[unit] = _UNIT
    return starts, ends, code, at, plain


def windows(code: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, text and hash of every usable window of width tokens."""
    n = len(code) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(width << 32)) | np.uint64(1)
    rolled = np.full(n, width, np.uint64)
    literal = np.zeros(n, np.int64)
    for j in range(width):
        rolled += code[j : j + n] * factor[j]
        literal += code[j : j + n] > _NAME
    text = np.searchsorted(at, np.arange(n), side="right") - 1
    good = np.flatnonzero((np.arange(n) + width <= at[text + 1]) & (literal >= min(LITERALS, width)))
    return good, text[good], mix(rolled[good])


_ROWS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("slots", pa.list_(pa.string()))])
_ROWS_DDL = "id long, hash long, pos long, slots array<string>"


#: Sets hashes of verbatim windows apart.
_VERBATIM = np.uint64(0x5851F42D4C957F2D)


def window_rows(table: DataFrame, id_col: str, text_col: str, widths: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, hash, pos, slots) of the windows of every text, slots null for verbatim ones; widths None: WINDOW, or the whole of shorter texts.
    wanted: sorted hashes to keep."""
    shared = table.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value if shared else None
        if keep is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(keep & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                ids = batch.column("id").to_numpy()
                part, offsets = code_points(batch.column("text"))
                starts, ends, code, at, plain = tokens(part, offsets)
                sizes = np.diff(at)
                for width in widths or sorted({int(min(s, WINDOW)) for s in sizes if s}):
                    for verbatim in (False, True):
                        first, text, hashed = windows(plain if verbatim else code, at, width)
                        if verbatim:
                            hashed = mix(hashed ^ _VERBATIM)
                        if widths is None:
                            good = np.minimum(sizes[text], WINDOW) == width
                            first, text, hashed = first[good], text[good], hashed[good]
                        if keep is not None:
                            good = np.flatnonzero(sieve[(hashed & np.uint64((1 << 22) - 1)).astype(np.int64)])
                            spot = np.minimum(np.searchsorted(keep, hashed[good]), len(keep) - 1)
                            good = good[keep[spot] == hashed[good]]
                            first, text, hashed = first[good], text[good], hashed[good]
                        if not len(first):
                            continue
                        slots = [None] * len(first)
                        if not verbatim:
                            slots = [[part[starts[i] : ends[i]].tobytes().decode("utf-32-le", "replace").lower() for i in range(f, f + width) if code[i] <= _NAME] for f in first.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(hashed.view(np.int64)), pa.array(first - at[text]), pa.array(slots, pa.list_(pa.string()))], schema=_ROWS)

    picked = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), _ROWS_DDL)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """Linked pairs: id, item_id, n_windows, item_windows, coverage, reparameterised."""
    items = window_rows(benchmark, "item_id", "text", None).select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("ipos"), F.col("slots").alias("islots"))
    typed, verbatim = F.col("islots").isNotNull(), F.col("islots").isNull()
    sizes = items.groupBy("item_id").agg(F.countDistinct(F.when(typed, F.col("hash"))).alias("all_typed"), F.countDistinct(F.when(verbatim, F.col("hash"))).alias("all_verbatim"))
    distinct = items.select("hash").distinct()
    known = distinct.limit(FILTER_WINDOWS + 1).toArrow().column("hash").to_numpy()  # 8 bytes each
    wanted = np.sort(known.view(np.uint64)) if len(known) <= FILTER_WINDOWS else None
    if wanted is not None and not len(wanted):
        wanted = np.zeros(1, np.uint64)
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("text").cast("string").alias("text"))
    widths = sorted({r["w"] for r in rows.mapInArrow(_widths, "w int").distinct().collect()}) or [WINDOW]  # at most WINDOW values
    hits = window_rows(docs, id_col, text_col, widths, wanted)
    met = hits.join(items, "hash").where(F.col("slots").isNull() == verbatim)
    pairs = F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d"))
    # slot values of one diagonal: (item value, document value) must be a function
    lined = met.groupBy("id", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
        F.collect_set(F.struct(verbatim.alias("verbatim"), "hash")).alias("hashes"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        F.array_sort(F.collect_set(F.when(verbatim, F.col("ipos")))).alias("at"),
    )
    values = F.transform("pairs", lambda p: F.coalesce(p["i"], F.lit("")))
    consistent = lined.where(F.size(F.array_distinct(values)) == F.size(values))
    changed = F.exists("pairs", lambda p: ~p["i"].eqNullSafe(p["d"]))
    run = RUN - WINDOW + 1  # verbatim windows, each one token on
    follows = F.exists(F.sequence(F.lit(run), F.size("at")), lambda i: F.element_at("at", i.cast("int")) - F.element_at("at", (i - (run - 1)).cast("int")) == run - 1)
    long = F.when(F.size("at") >= run, follows).otherwise(False)
    parts = consistent.select("id", "item_id", F.explode("hashes").alias("h"), changed.alias("changed"), long.alias("long"))
    linked = parts.groupBy("id", "item_id").agg(
        F.countDistinct(F.when(~F.col("h.verbatim"), F.col("h.hash"))).alias("typed"), F.countDistinct(F.when(F.col("h.verbatim"), F.col("h.hash"))).alias("verbatim"), F.max("changed").alias("changed"), F.max("long").alias("long")
    )
    by_slots = (F.col("typed") > 0) & (F.col("typed") >= cover * F.col("all_typed"))
    out = linked.join(sizes, "item_id").where(by_slots | F.col("long") | (F.col("verbatim") > 0) & (F.col("verbatim") >= cover * F.col("all_verbatim")))
    out = out.select("id", "item_id", F.when(by_slots, F.col("typed")).otherwise(F.col("verbatim")).alias("n_windows"), F.when(by_slots, F.col("all_typed")).otherwise(F.col("all_verbatim")).alias("item_windows"), (by_slots & F.col("changed")).alias("reparameterised"))
    out = out.withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    return out.select(F.col("id").alias(id_col), "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(tokens(*code_points(b.column("text")))[3]) for b in slices(whole, "text", CHUNK_BYTES))])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(sizes[sizes > 0], WINDOW)).astype(np.int32))], names=["w"])
