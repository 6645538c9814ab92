"""Repeated passages across documents (operator 9): longest previous factors over a distributed suffix order.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller id. In
terms of longest-previous-factor arrays: a suffix is marked if its longest factor that occurs in an earlier
document is at least LENGTH bytes long. Suffixes need be in order only among those that can match that far, so:

1. Exact copies of a text are covered as a whole by the first one; only first copies go on.
2. Every string of LENGTH bytes has an anchor, the least hash among its k-byte substrings (leftmost on ties),
   which depends on its content alone. Neighbouring suffixes share anchors: a run is (anchor, first and last
   suffix). Anchors are dealt by hash, as arrays; those that stand in one document only cannot match, the others
   go back to their documents.
3. For the runs that are left, the text from the first suffix to the end of the last one is sent to the
   anchor's bucket, once per distinct text and partition batch, with the smallest id; other holders in the batch
   are marked at once. Equal suffixes of LENGTH bytes meet in one bucket, as they have the same anchor.
4. A bucket sorts its suffixes and takes the common prefixes of neighbours. The previous and the next smaller
   position of a suffix (the nearest ones in suffix order that belong to a document with a smaller id), with the least
   common prefix on the way, give its longest previous factor; suffixes whose factor has LENGTH bytes are marked. A
   way is left where its common prefix falls below LENGTH, so factors shorter than that count as none.
5. Marks go back to the documents, whose covered bytes are removed.

A passage in a third of all documents reaches its bucket once per batch, not once per document.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows with equal ids are one document,
so they take nothing from each other; rows without an id lose nothing and give nothing; every row gives one
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, mix, prefix_hash, shuffle_partitions, tidy, utf8

#: Length of a repeated string in bytes, and of an anchor.
LENGTH = 50
ANCHOR = 20
#: Text handled as one batch in bytes.
BATCH_BYTES = 8_000_000
#: Text of a bucket in bytes, on average at most: what a task holds does not grow with the input.
BUCKET_BYTES = 8_000_000
#: Parts of a bucket; a task orders the suffixes of one part at a time.
FINE = 16


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor position, first and last suffix, anchor hash and text of every run, in order of suffixes."""
    n, none = len(data), np.empty(0, np.int64)
    if n < length:
        return none, none, none, np.empty(0, np.uint64), none
    s, down = prefix_hash(data)
    h = mix((s[k:] - s[: n - k + 1]) * down[: n - k + 1])
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, size = length - k + 1, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    edge = np.zeros(n - length + 2, np.int32)
    begin, end = offsets[:-1], offsets[1:] - length + 1
    good = end > begin
    np.add.at(edge, begin[good], 1)
    np.add.at(edge, end[good], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(at):
        return none, none, none, np.empty(0, np.uint64), none
    anchor = (least[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return anchor[first], at[first], at[last], h[anchor[first]], np.searchsorted(offsets, at[first], side="right") - 1


# ---------------------------------------------------------------- step 2: anchors in several documents
_A = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("places", pa.binary())])
_ID_BLOB = pa.schema([("id", pa.int64()), ("places", pa.binary())])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for group in np.split(order, edges) if len(order) else []:
        yield int(bucket[group[0]]), group


def _anchors(buckets: int, length: int, k: int):
    """Map: per batch and bucket the documents, their numbers of anchors, and each anchor's key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data, offsets = utf8(batch.column("text"))
            for blo, bhi in chunks(offsets, BATCH_BYTES):
                found: list[tuple] = []
                for lo, hi in ((blo + a, blo + b) for a, b in chunks(offsets[blo : bhi + 1] - offsets[blo])):
                    local = offsets[lo : hi + 1] - offsets[lo]
                    anchor, _, _, h, text = runs(data[offsets[lo] : offsets[hi]], local, length, k)
                    found.append((h, text + lo, (anchor - local[text]).astype(np.uint32)))
                if not found:
                    continue
                h, text, place = (np.concatenate(x) for x in zip(*found))
                rows = []
                for b, group in _by_bucket((h % np.uint64(buckets)).astype(np.int64)):
                    docs, sizes = np.unique(text[group], return_counts=True)
                    rows.append((b, ids[docs].tobytes(), sizes.astype(np.uint32).tobytes(), (h[group] >> np.uint64(32)).astype(np.uint32).tobytes(), _steps(place[group], sizes)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _A.types)], schema=_A)

    return run


def _per_document(ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.diff(ids[order])) + 1
    for group in np.split(order, edges) if len(order) else []:
        yield int(ids[group[0]]), [c[group] for c in columns]


def _steps(place: np.ndarray, sizes: np.ndarray) -> bytes:
    """Places as 16-bit steps within each document, or as they are if a step is larger."""
    first = np.cumsum(sizes) - sizes
    step = np.diff(place.astype(np.int64), prepend=0)
    step[first] = place[first]
    return step.astype(np.uint16).tobytes() if step.max(initial=0) < 1 << 16 else place.tobytes()


def _places(blob: bytes, sizes: np.ndarray) -> np.ndarray:
    n = int(sizes.sum())
    if len(blob) == 4 * n:
        return np.frombuffer(blob, np.uint32)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    step = np.frombuffer(blob, np.uint16).astype(np.int64)
    total = np.cumsum(step)
    return (total - np.repeat(total[first] - step[first], sizes)).astype(np.uint32)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce: the places of anchors whose key stands in several documents, by document."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for b, *blobs in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in ("ids", "sizes", "keys", "places"))):
            held.setdefault(b, []).append(tuple(x.as_py() for x in blobs))
    for b in list(held):
        parts = held.pop(b)
        ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(s, np.uint32)) for i, s, _, _ in parts])
        keys = np.concatenate([np.frombuffer(k, np.uint32) for _, _, k, _ in parts])
        places = np.concatenate([_places(p, np.frombuffer(s, np.uint32)) for _, s, _, p in parts])
        order = np.argsort(keys, kind="stable")
        sorted_keys, sorted_ids = keys[order], ids[order]
        heads = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        several = np.minimum.reduceat(sorted_ids, heads) < np.maximum.reduceat(sorted_ids, heads)
        good = order[np.repeat(several, np.diff(np.append(heads, len(order))))]
        rows = [(key, p.tobytes()) for key, (p,) in _per_document(ids[good], places[good])]
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), _ID_BLOB.types)], schema=_ID_BLOB)


# ---------------------------------------------------------------- step 3: runs of shared anchors
_B = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("marks", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])


def _mark_rows(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, bucket: int) -> Iterator[tuple]:
    """Rows of marked suffix ranges (first, last) by document."""
    for key, (a, b) in _per_document(ids, starts, ends):
        yield bucket, key, np.stack([a, b]).astype(np.uint32).tobytes(), None, None, None, None


def _segments(buckets: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data, offsets = utf8(batch.column("text"))
            places = batch.column("places")
            for blo, bhi in chunks(offsets, BATCH_BYTES):
                found = []
                for lo, hi in ((blo + a, blo + b) for a, b in chunks(offsets[blo : bhi + 1] - offsets[blo])):
                    local = offsets[lo : hi + 1] - offsets[lo]
                    part = data[offsets[lo] : offsets[hi]]
                    anchor, first, last, h, text = runs(part, local, length, k)
                    shared = np.zeros(len(part) + 1, bool)
                    for i in range(lo, hi):
                        for blob in places[i]:
                            shared[local[i - lo] + np.frombuffer(blob.as_buffer(), np.uint32)] = True
                    good = shared[anchor]
                    anchor, first, last, h, text = (x[good] for x in (anchor, first, last, h, text))
                    s, down = prefix_hash(part)
                    content = mix((s[last + length] - s[first]) * down[first] + (anchor - first).astype(np.uint64))
                    found.append((content, h, text + lo, first - local[text], last - first, first + offsets[lo]))
                content, h, text, start, more, at = (np.concatenate(x) for x in zip(*found))
                if not len(h):
                    continue
                own = ids[text]
                # equal segments of the batch: only the holders with the smallest id go on
                order = np.lexsort((own, content))
                head = np.append(True, content[order][1:] != content[order][:-1])
                least = own[order][np.flatnonzero(head)][np.cumsum(head) - 1]
                later = np.zeros(len(h), bool)
                later[order] = own[order] > least
                rows = []
                gone = np.flatnonzero(later)
                rows += _mark_rows(own[gone], start[gone], start[gone] + more[gone], buckets + int(own[0]) % buckets)
                keep = np.flatnonzero(~later)
                where = (h[keep] % np.uint64(buckets * FINE)).astype(np.int64)
                for b, group in _by_bucket(where // FINE):
                    group = group[np.argsort(where[group], kind="stable")]
                    counts = np.bincount(where[group] % FINE, minlength=FINE).astype(np.uint32)
                    g = keep[group]
                    body = b"".join(data[a : a + n].tobytes() for a, n in zip(at[g].tolist(), (more[g] + length).tolist()))
                    rows.append((b, None, counts.tobytes(), own[g].tobytes(), start[g].astype(np.uint32).tobytes(), more[g].astype(np.uint16).tobytes(), body))
                for lo in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 1000]), _B.types)], schema=_B)

    return run


# ---------------------------------------------------------------- step 4: suffix order and previous factors
def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` by their first `length` bytes; and for each place in that order the longest common
    prefix with the one before, in bytes, at most length (0 for the first)."""
    padded = np.append(data, np.zeros(16, np.uint8)).astype(np.uint64)
    n = len(data)
    words = np.zeros(n + 8, np.uint64)
    for j in range(8):
        words |= padded[j : j + n + 8] << np.uint64(56 - 8 * j)
    columns = []
    for j in range(0, length, 8):
        column = words[at + j]
        if j + 8 > length:
            column = column >> np.uint64(8 * (j + 8 - length)) << np.uint64(8 * (j + 8 - length))
        columns.append(column)
    order = np.lexsort(columns[::-1])
    prefix = np.full(len(at), length, np.int64)
    prefix[:1] = 0
    alive = np.arange(1, len(at))  # places whose words were equal so far
    for j, column in enumerate(columns):
        apart = column[order[alive]] ^ column[order[alive - 1]]
        ends = np.flatnonzero(apart)
        same = np.zeros(len(ends), np.int64)
        for k in range(1, 8):
            same += apart[ends] >> np.uint64(64 - 8 * k) == 0
        prefix[alive[ends]] = 8 * j + same
        alive = alive[apart == 0]
    return order, prefix


def smaller_positions(prefix: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with its previous smaller position, 0 where that is below least. All places
    jump at once: a place whose pointer is no smaller one takes over that one's pointer."""
    n = len(owner)
    to, common = np.arange(-1, n - 1), prefix.copy()
    open_ = np.flatnonzero(common >= least)
    common[common < least] = 0
    while len(open_):
        j = to[open_]
        on = open_[owner[j] >= owner[open_]]
        j = to[on]
        step = np.minimum(common[on], common[j])
        further = to[j]
        common[on], to[on] = step, further
        open_ = on[step >= least]
        common[on[step < least]] = 0
    return common


def longest_previous_factors(prefix: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """For each place in suffix order the longest factor that it shares with an earlier owner, 0 if below least."""
    before = smaller_positions(prefix, owner, least)
    back = np.append(0, prefix[:0:-1])  # the same order read from its end
    after = smaller_positions(back, owner[::-1], least)[::-1]
    return np.maximum(before, after)


def _factors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            through = batch.filter(batch.column("id").is_valid())
            if through.num_rows:
                yield pa.RecordBatch.from_arrays([through.column("id"), through.column("marks")], schema=_MARKS)
            own = batch.filter(batch.column("id").is_null())
            for b, *blobs in zip(own.column("bucket").to_pylist(), *(own.column(c) for c in ("marks", "ids", "starts", "sizes", "bytes"))):
                counts, ids, starts, sizes, data = (np.frombuffer(x.as_py(), t) for x, t in zip(blobs, (np.uint32, np.int64, np.uint32, np.uint16, np.uint8)))
                ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + length)])
                at = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist()
                for part, (lo, hi) in enumerate(zip(at, at[1:])):
                    if hi > lo:
                        held.setdefault((b, part), []).append((ids[lo:hi], starts[lo:hi], sizes[lo:hi], data[ends[lo] : ends[hi]]))
        for key in list(held):
            parts = held.pop(key)
            ids, starts, sizes, data = (np.concatenate([p[i] for p in parts]) for i in range(4))
            rows = _marked(ids, starts.astype(np.int64), sizes.astype(np.int64), data, length)
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000]), _MARKS.types)], schema=_MARKS)

    return run


def _marked(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray, length: int) -> list[tuple]:
    """Marked suffix ranges of one bucket's segments, by document."""
    begin = np.concatenate([[0], np.cumsum(sizes + length)[:-1]])
    number = sizes + 1  # suffixes of each segment
    segment = np.repeat(np.arange(len(ids)), number)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(number) - number, number)
    order, prefix = suffix_order(data, begin[segment] + step, length)
    marked = np.zeros(len(segment), bool)
    marked[order] = longest_previous_factors(prefix, ids[segment][order], length) >= length
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    new = np.append(True, (np.diff(at) != 1) | (np.diff(segment[at]) != 0))
    first = at[np.flatnonzero(new)]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    base = starts[segment[first]]
    return [(r[1], r[2]) for r in _mark_rows(ids[segment[first]], base + step[first], base + step[last], 0)]


_MARKS = pa.schema([("id", pa.int64()), ("marks", pa.binary())])


# ---------------------------------------------------------------- operator
def covered(size: int, blobs: list[bytes], whole: bool, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that marked suffix ranges cover, in order."""
    if whole:
        return [(0, size)] if size >= length else []
    pairs = sorted((a, b + length) for blob in blobs for a, b in zip(*np.frombuffer(blob, np.uint32).reshape(2, -1).tolist()))
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs' ids and texts with what to remove: id, text, blobs (marked suffix ranges), whole (a later exact copy)."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = every.where("id is not null")  # joins ask for that; asked here, all uses of the dealt texts are one exchange
    digests = base.select("id", F.sha2("text", 256).alias("digest"))
    origin = digests.groupBy("digest").agg(F.min("id").alias("origin"))
    # a repeated id may come with several texts: it is a first copy if any of its texts is
    first = origin.select(F.col("origin").alias("id")).distinct().withColumn("first", F.lit(True))
    dealt = base.repartition(buckets, "id")
    unique = dealt.join(first.select("id"), "id")  # ids are distinct there; a semi join would go below the exchange
    spread = unique.mapInArrow(tidy(_anchors(buckets, length, anchor)), "bucket int, ids binary, sizes binary, keys binary, places binary")
    shared = spread.repartition(buckets, "bucket").mapInArrow(tidy(_shared_anchors), "id long, places binary")
    shared = shared.groupBy("id").agg(F.collect_list("places").alias("places"))
    segments = unique.join(shared, "id").select("id", "text", "places").mapInArrow(
        tidy(_segments(buckets, length, anchor)), "bucket int, id long, marks binary, ids binary, starts binary, sizes binary, bytes binary"
    )
    marks = segments.repartition(buckets, "bucket").mapInArrow(tidy(_factors(length)), "id long, marks binary")
    marks = marks.groupBy("id").agg(F.collect_list("marks").alias("blobs"))
    found = dealt.join(first, "id", "left").join(marks, "id", "left").select("id", "text", "blobs", F.col("first").isNull().alias("whole"))
    return found.unionByName(every.where("id is null").select("id", "text", F.lit(None).cast("array<binary>").alias("blobs"), F.lit(False).alias("whole")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, contents: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left; null
    without contents)."""
    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blobs, whole in zip(*(batch.column(c) for c in ("text", "blobs", "whole"))):
                raw = text.as_buffer().to_pybytes()
                spans = covered(len(raw), blobs.as_py() or [], whole.as_py(), length)
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                body = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(body), len(spans), hashlib.sha256(body).hexdigest(), body if contents else None))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), out.types[1:]))], schema=out)

    spans = repeated_spans(docs, id_col, text_col, length)
    done = spans.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumnRenamed("id", id_col)
