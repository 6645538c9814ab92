"""Toxicity (operator 8): nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Fitting. Labels are learned only from documents outside the held-out fold. At most EXAMPLES documents of each
class are examples (the documents with the smallest hash of their id): that bound is the one on the model, and
everything that is broadcast depends on it and on TERMS alone. All words of the examples are terms. Words and word
beginnings, once more for their second and third occurrence in a text, whose presence marks toxic examples most
(G statistic, at least RATIO times the other class's rate; equal texts count once) are marks: terms as well, and
weighted RATIO-fold. Document frequencies are counted over all documents.

Scoring. Each document's TF-IDF vector over all words of the examples and the marks is compared with all examples
of both classes, many documents at a time. Common terms stand in most examples: their part of all cosines is one
product of matrices (in single precision; cosines are rounded to DIGITS). The other terms have postings, in blocks of
alike examples; a block whose bound (greatest common part, plus query weights times the block's greatest weights)
cannot beat the worst of the K best so far is not scored further, so the K nearest are exact. Votes are weighted by squared cosine and by how many labelled
documents an example stands for; a prior of PRIOR votes has the rate of toxic labels among examples without any
mark. Nearest examples and the marks found are the evidence.

Words are runs of letters in lower case, kept as 64-bit hashes; beginnings are counted in bytes of UTF-8.

Defined cases: null text is empty; a text without a term has the prior rate as its score; conflicting
labels of one id count as toxic; null labels are no labels; without labels of both classes every score is the
share of toxic labels (0 without labels); every row gives one row, rows with repeated or null ids included
(null: not held out); other columns are ignored. Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, chunks, cut, drop, mix, prefix_hash, slices, small_batches, tidy, trim, utf8

#: Labelled examples of each class at most, and marks at most.
EXAMPLES = 3000
TERMS = 4000
#: Least ratio of a term's rates in toxic and other examples.
RATIO = 4
#: Least G statistic of a term: GAIN, and GAIN_SHARE of the greatest one (more examples bring more chance terms).
GAIN = 10.0
GAIN_SHARE = 0.005
#: Neighbours that vote, examples of a block, blocks scored before the first bound, weight of the prior.
K = 15
BLOCK = 64
FIRST_BLOCKS = 4
PRIOR = 0.5
#: Lengths of word beginnings that are terms beside whole words, in bytes.
STEMS = (4, 5, 6)
#: Occurrences in one text up to which each makes a further term.
REPEATS = 3
#: Digits of a cosine.
DIGITS = 6
#: Documents that are scored at a time, and whose postings are read at a time. Terms in at least this share of the examples are common, but for the rarest
#: beyond COMMON_TERMS.
TOGETHER = 128
ROWS = 32
COMMON = 0.04
COMMON_TERMS = 1024
#: Bytes of text whose words are found at once: about as many documents as are scored at a time.
PIECE = CHUNK_BYTES // 4


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


# ---------------------------------------------------------------- terms
@dataclass
class Words:
    """Words of some texts: bytes, starts, ends, hash, text of each; n texts from row lo on."""

    lo: int
    n: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than size, and hashes of their first size bytes."""
        long = np.flatnonzero(self.ends - self.starts > size)
        a = self.starts[long]
        return long, mix((self.sums[a + size] - self.sums[a]) * self.down[a] + np.uint64(size << 32))


def words_of(column: pa.Array, limit: int = PIECE) -> Iterator[Words]:
    """The words of a text column, in parts of rows of about limit bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit):
        low = pc.utf8_lower(column.slice(lo, hi - lo).fill_null(""))
        part, at = utf8(pc.replace_substring_regex(low, pattern=r"[^\pL]+", replacement=" "))
        n = len(part)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        solid = part != 32
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums, down = prefix_hash(part)
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield Words(lo, hi - lo, part, starts, ends, hashes, np.searchsorted(at, starts, side="right") - 1, sums, down)


def counted(owner: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key), by owner then key, and how often each stands; keys are below size."""
    both = np.sort(owner.astype(np.int64) * size + key)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return both[at] // size, both[at] % size, np.diff(np.append(at, len(both)))


@dataclass
class Vocabulary:
    """Terms as sorted base hashes; term: the index of the base itself and of its further occurrences, or -1."""

    bases: np.ndarray
    term: np.ndarray  # bases x REPEATS
    size: int
    beginning: np.ndarray  # sorted hashes of beginnings that matter
    slots: np.ndarray  # a base for each remainder of hashes

    @classmethod
    def of(cls, words: np.ndarray, marks: list[tuple[int, int, int]]) -> "Vocabulary":
        """words: hashes of the words that are terms; marks: (hash of the base, bytes of a beginning or 0, times)."""
        own = np.array([m[0] for m in marks], np.uint64)
        bases = np.unique(np.concatenate([words, own]))
        term = np.full((len(bases), REPEATS), -1, np.int32)
        term[np.searchsorted(bases, words), 0] = 1
        for (_, _, times), at in zip(marks, np.searchsorted(bases, own)):
            term[at, times - 1] = 1
        used = term.ravel() > 0
        term.ravel()[used] = np.arange(int(used.sum()))
        return cls(bases, term, int(used.sum()), np.unique(own[[m[1] > 0 for m in marks]]) if marks else own, cls.table(bases))

    @staticmethod
    def table(bases: np.ndarray) -> np.ndarray:
        slots = np.full(1 << max(10, (8 * len(bases)).bit_length()), -1, np.int32)
        slots[(bases & np.uint64(len(slots) - 1)).astype(np.int64)] = np.arange(len(bases))
        return slots

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are bases, and their places."""
        at = self.slots[(hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)].astype(np.int64)
        good = (at >= 0) & (self.bases[at] == hashes)
        other = np.flatnonzero((at >= 0) & ~good)  # bases that share a remainder
        spot = np.minimum(np.searchsorted(self.bases, hashes[other]), len(self.bases) - 1)
        at[other], good[other] = spot, self.bases[spot] == hashes[other]
        return np.flatnonzero(good), at[good]

    def index(self, base: int, times: int) -> int:
        return int(self.term[np.searchsorted(self.bases, np.uint64(base)), times - 1])

    def vectors(self, part: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, frequency) of a part's texts, by text."""
        if not len(self.bases):
            none = np.empty(0, np.int64)
            return none, none, none
        hashes, owner = [part.hashes], [part.text]
        if len(self.beginning):
            for size in STEMS:
                long, h = part.beginnings(size)
                good = self.beginning[np.minimum(np.searchsorted(self.beginning, h), len(self.beginning) - 1)] == h
                hashes.append(h[good])
                owner.append(part.text[long[good]])
        h, of = np.concatenate(hashes), np.concatenate(owner)
        good, at = self.find(h)
        of, at, n = counted(of[good], at, len(self.bases))
        columns = [(of, self.term[at, 0], n)]
        for times in range(2, REPEATS + 1):
            more = (n >= times) & (self.term[at, times - 1] >= 0)
            columns.append((of[more], self.term[at[more], times - 1], n[more]))
        of, term, n = (np.concatenate(c) for c in zip(*columns))
        known = term >= 0
        order = np.argsort(of[known], kind="stable")
        return of[known][order], term[known][order], n[known][order]


# ---------------------------------------------------------------- index
def alike_order(owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, size: int = BLOCK) -> np.ndarray:
    """Rows of a sparse matrix in an order that brings alike ones together: random projections, halved again and again
    along the direction of greatest spread."""
    flat = np.stack([np.bincount(owner, value * (1 - 2 * (mix(term.astype(np.uint64) * np.uint64(64) + np.uint64(i)) >> np.uint64(63)).astype(float)), n) for i in range(16)], axis=1)
    out: list[np.ndarray] = []
    todo = [np.arange(n)]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = flat[rows] - flat[rows].mean(axis=0)
        along = x @ np.linalg.svd(x.T @ x)[0][:, 0]
        rows = rows[np.argsort(along, kind="stable")]
        half = -(-len(rows) // (2 * size)) * size
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.arange(n)


@dataclass
class Index:
    """Block-max inverted index of labelled examples."""

    vocabulary: Vocabulary
    idf: np.ndarray
    marks: dict[int, str]
    prior: float
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # terms + 1: where a term's blocks begin
    block: np.ndarray  # blocks that hold a term, by term, then block
    most: np.ndarray  # greatest weight of the term there
    start: np.ndarray  # where the term's postings of that block begin
    members: np.ndarray  # examples of the postings, by term, then example
    values: np.ndarray  # their normalised weights
    common: np.ndarray  # row of each term in the matrix of common terms, or -1
    made: dict = field(default_factory=dict)

    @classmethod
    def build(cls, vocabulary: Vocabulary, idf: np.ndarray, marks: dict[int, str], prior: float, ids: np.ndarray, toxic: np.ndarray, weight: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> "Index":
        """owner, term, tf: frequencies of the examples' terms, examples by their place in ids."""
        n, size = len(ids), vocabulary.size
        values = (1 + np.log(tf)) * idf[term]
        values /= np.sqrt(np.bincount(owner, values * values, n))[owner] if len(owner) else 1
        order = alike_order(owner, term, values, n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        members = place[owner]
        by = np.lexsort((members, term))
        members, term, values = members[by], term[by], values[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (members[1:] // BLOCK != members[:-1] // BLOCK)
        start = np.flatnonzero(new)
        most = np.maximum.reduceat(values, start) if len(start) else values
        first = np.searchsorted(term[start], np.arange(size + 1)).astype(np.int32)
        often = np.bincount(term, minlength=size)
        top = np.argsort(-often, kind="stable")[:COMMON_TERMS]
        top = top[often[top] >= max(COMMON * n, 2)]
        common = np.full(size, -1, np.int32)
        common[top] = np.arange(len(top))
        return cls(vocabulary, idf, marks, prior, ids[order], toxic[order].astype(float), weight[order], first, (members[start] // BLOCK).astype(np.int32), most.astype(np.float32), np.append(start, len(term)).astype(np.int32), members.astype(np.int32), values.astype(np.float32), common)

    def matrix(self) -> np.ndarray:
        """Common terms by examples, dense; made once where it is used."""
        if "matrix" not in self.made:
            out = np.zeros((int(self.common.max(initial=-1)) + 1, len(self.ids)), np.float32)
            term = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.start[self.first[1:]] - self.start[self.first[:-1]])
            row = self.common[term]
            out[row[row >= 0], self.members[row >= 0]] = self.values[row >= 0]
            self.made["matrix"] = out
        return self.made["matrix"]

    def nearest(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, cosine, example) of the k examples of greatest cosine above 0 of each of n texts, ties to the smaller
        id; by text, best first."""
        size = len(self.ids)
        none = np.empty(0, np.int64)
        if not size or not len(owner):
            return none, np.empty(0), none
        q = (1 + np.log(tf)) * self.idf[term]
        q /= np.sqrt(np.bincount(owner, q * q, n))[owner]
        blocks = -(-size // BLOCK)
        thick = self.common[term] >= 0
        wide = np.zeros((n, len(self.matrix())), np.float32)
        wide[owner[thick], self.common[term[thick]]] = q[thick]
        score = (wide @ self.matrix()).astype(float)
        term, q, owner = term[~thick], q[~thick], owner[~thick]
        pairs, which = _ranges(self.first[term], self.first[term + 1])
        row_of = owner[which]
        w, spot = q.astype(np.float32)[which], row_of * blocks + self.block[pairs]
        cuts = np.searchsorted(row_of, np.arange(0, n + ROWS, ROWS)).tolist()
        bound = np.bincount(spot, w * self.most[pairs], n * blocks).reshape(n, blocks).astype(float)  # of whole numbers if empty
        bound += np.maximum.reduceat(score, np.arange(0, size, BLOCK), axis=1)

        def add(wanted: np.ndarray) -> None:
            """Postings of the wanted blocks of each text."""
            keep = wanted.ravel()[spot]
            for top, lo, hi in zip(range(0, n, ROWS), cuts, cuts[1:]):  # a few texts at a time: small arrays
                some = lo + np.flatnonzero(keep[lo:hi])
                postings, of = _ranges(self.start[pairs[some]], self.start[pairs[some] + 1])
                part = score[top : top + ROWS].reshape(-1)
                part += np.bincount(((row_of[some] - top) * size)[of] + self.members[postings], w[some][of] * self.values[postings], len(part))

        def kth() -> np.ndarray:
            return np.partition(score, size - k, axis=1)[:, size - k] if size > k else np.zeros(n)

        if blocks <= 2 * FIRST_BLOCKS:
            add(np.ones((n, blocks), bool))
        else:
            # the most promising blocks first, then all that can still beat the worst of the k best
            head = bound >= np.partition(bound, blocks - FIRST_BLOCKS, axis=1)[:, blocks - FIRST_BLOCKS, None]
            add(head)
            add((bound + 1e-5 >= kth()[:, None]) & ~head)
        np.round(score, DIGITS, out=score)
        least = kth()
        row, col = np.nonzero((score >= least[:, None]) & (score > 0))
        s = score[row, col]
        order = np.lexsort((self.ids[col], -s, row))
        row, col, s = row[order], col[order], s[order]
        good = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[good], s[good], col[good]

    def scores(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[list[int]], list[list[str]]]]:
        """Score, ids of the nearest examples and marks found, for the texts of a column, in parts of rows."""
        for part in words_of(column):
            owner, term, tf = self.vocabulary.vectors(part)
            for lo in range(0, part.n, TOGETHER):
                n = min(TOGETHER, part.n - lo)
                a, b = np.searchsorted(owner, [lo, lo + n])
                row, s, near = self.nearest(owner[a:b] - lo, term[a:b], tf[a:b], n)
                votes = s * s * self.weight[near]
                out = (np.bincount(row, votes * self.toxic[near], n) + PRIOR * self.prior) / (np.bincount(row, votes, n) + PRIOR)
                evidence: list[list[int]] = [[] for _ in range(n)]
                for r, i in zip(row.tolist(), self.ids[near].tolist()):
                    if len(evidence[r]) < 5:
                        evidence[r].append(i)
                found: list[list[str]] = [[] for _ in range(n)]
                if self.marks:
                    marked = np.flatnonzero(self.marked()[term[a:b]]) + a
                    for r, t in zip((owner[marked] - lo).tolist(), term[marked].tolist()):
                        found[r].append(self.marks[t])
                yield out, evidence, found

    def marked(self) -> np.ndarray:
        if "marked" not in self.made:
            self.made["marked"] = np.isin(np.arange(self.vocabulary.size), list(self.marks))
        return self.made["marked"]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from lo to hi, and the range of each."""
    n = (hi - lo).astype(np.int32)
    before = np.cumsum(n, dtype=np.int64) - n
    which = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(len(which), dtype=np.int32) + (lo - before).astype(np.int32)[which], which


# ---------------------------------------------------------------- fitting
_SEEN = pa.schema([("base", pa.int64()), ("bytes", pa.int32()), ("times", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("name", pa.string())])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words and word beginnings, and of their further occurrences: examples of either class that hold them."""
    for batch in batches:
        for part in words_of(batch.column("text"), CHUNK_BYTES):
            y = batch.column("y").slice(part.lo, part.n).to_numpy()
            for size in (0, *STEMS):
                which, h = part.beginnings(size) if size else (np.arange(len(part.hashes)), part.hashes)
                every, spot, place = np.unique(h, return_index=True, return_inverse=True)
                owner, base, n = counted(part.text[which], place, max(len(every), 1))
                for times in range(1, REPEATS + 1):
                    good = n >= times
                    keys, at = np.unique(base[good], return_inverse=True)
                    if not len(keys):
                        continue
                    ones = np.bincount(at, y[owner[good]], len(keys)).astype(np.int64)
                    spots = which[spot[keys]]
                    ends = part.ends[spots] if not size else part.starts[spots] + size
                    names = [part.data[a:b].tobytes().decode(errors="replace") + "-" * bool(size) + f"*{times}" * (times > 1) for a, b in zip(part.starts[spots].tolist(), ends.tolist())]
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(every[keys].view(np.int64)), pa.array(np.full(m, size, np.int32)), pa.array(np.full(m, times, np.int32)), pa.array(np.bincount(at, minlength=m) - ones), pa.array(ones), pa.array(names, pa.string())], schema=_SEEN)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds_left_out: bool = True) -> Index:
    """Learn the index from labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).where("y in (0, 1)")
    if folds_left_out:
        known = known.where(fold(F.col("id")) != 0)
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES) for y in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most 2 * EXAMPLES rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    files: list[str] = []
    sample = cut(texts.groupBy("text", "y").agg(F.min("id").alias("id")), files)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = total.get(1, 0) / max(sum(total.values()), 1)
    none = np.empty(0, np.int64)
    if not sizes.get(0) or not sizes.get(1):
        drop(docs.sparkSession, files)
        return Index.build(Vocabulary.of(none.astype(np.uint64), []), np.empty(0), {}, rate, none, none, np.empty(0), none, none, none)

    found = sample.select("text", "y").mapInArrow(tidy(_statistics), "base long, bytes int, times int, n0 long, n1 long, name string")
    found = found.groupBy("base", "bytes", "times").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("name").alias("name"))
    a, b = float(sizes[0]), float(sizes[1])
    whole = F.col("n0") + F.col("n1")

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    miss0, miss1 = F.lit(a) - F.col("n0"), F.lit(b) - F.col("n1")
    gain = 2 * (part(F.col("n0"), whole * (a / (a + b))) + part(F.col("n1"), whole * (b / (a + b))) + part(miss0, (F.lit(a + b) - whole) * (a / (a + b))) + part(miss1, (F.lit(a + b) - whole) * (b / (a + b))))
    marked = (F.col("n1") + 0.5) / (b + 1) >= RATIO * (F.col("n0") + 0.5) / (a + 1)
    picks = found.where("n0 + n1 >= 3").where(marked).withColumn("gain", gain).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "name").limit(TERMS).collect()
    picked = [r for r in picks if r["gain"] >= GAIN + GAIN_SHARE * picks[0]["gain"]]
    marks = [(r["base"] % (1 << 64), r["bytes"], r["times"]) for r in picked]

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in words_of(batch.column("text"), CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(p.hashes).view(np.int64))], names=["h"])

    words = sample.select("text").mapInArrow(spelt, "h long").distinct().toArrow().column("h").to_numpy().view(np.uint64)  # words of the examples
    vocabulary = Vocabulary.of(words, marks)
    names = {vocabulary.index(base, times): r["name"] for (base, _, times), r in zip(marks, picked)}
    n_docs, spread = frequencies(docs, vocabulary, text_col)
    weights = {0: (total[0] / a) / (total[1] / b), 1: 1.0}  # labelled documents that an example stands for, a toxic one as unit
    idf = np.log(1 + n_docs / np.maximum(spread, 1))
    idf[list(names)] *= RATIO

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in words_of(batch.column("text")):
                owner, term, tf = vocabulary.vectors(p)
                at = np.searchsorted(owner, np.arange(p.n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(p.lo, p.n), batch.column("y").slice(p.lo, p.n), *lists], names=["id", "y", "t", "n"])

    rows = sample.mapInArrow(tidy(vectors), "id long, y int, t array<int>, n array<int>").toArrow().combine_chunks()  # at most 2 * EXAMPLES
    drop(docs.sparkSession, files)
    ids, y = rows.column("id").to_numpy(), rows.column("y").to_numpy()
    order = np.lexsort((y, ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lengths = pc.list_value_length(rows.column("t")).to_numpy()
    owner = np.repeat(place, lengths)
    term, tf = (np.asarray(pc.list_flatten(rows.column(c)).to_numpy(), np.int64) for c in ("t", "n"))
    weight = np.where(y == 1, weights[1], weights[0]).astype(float)
    with_mark = np.bincount(owner, np.isin(term, list(names)), len(y))[place] > 0
    bare = {c: float((~with_mark & (y == c)).sum()) * weights[c] for c in (0, 1)}
    prior = (bare[1] + rate) / (bare[0] + bare[1] + 1)
    return Index.build(vocabulary, idf, names, float(prior), ids[order], y[order], weight[order], owner, term, tf)


def frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each term stands."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen, n = np.zeros(known.size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in words_of(batch.column("text")):
                seen += np.bincount(known.vectors(part)[1], minlength=known.size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"t": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(seen[at], n), pa.int64())})

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "t long, n long")
    found = parts.groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each term
    shared.unpersist()
    t, n = found.column("t").to_numpy(), found.column("n").to_numpy()
    spread = np.zeros(vocabulary.size)
    spread[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), spread


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, evidence (ids of the nearest examples), found (terms)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())), ("found", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for score, evidence, found in shared.value.scores(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(score)), pa.array(score), pa.array(evidence, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], schema=schema)
                at += len(score)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = picked.mapInArrow(tidy(run), "id long, score double, evidence array<long>, found array<string>")
    held = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "found")


def keep_civil(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under 0.5, all columns as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 4 * CHUNK_BYTES):  # what goes out is small, too
                score = np.concatenate([s for s, _, _ in shared.value.scores(batch.column(at).cast(pa.string()))])
                yield batch.filter(pa.array(score < 0.5))
            trim()

    return docs.mapInArrow(tidy(run), schema)
