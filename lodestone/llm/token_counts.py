"""Token counts (operator 10): pieces are counted once per distinct pre-token.

Plan, without materialising ids:

1. Every partition splits its texts into pre-tokens, batch by batch. Pre-tokens that are entries of the
   vocabulary file (a bounded set) are counted from a table made once per worker. Each other distinct
   pre-token of a batch is sent once to the bucket of its hash; the batch's postings (document, pre-token,
   frequency) travel beside them under the batch's key.
2. A bucket counts the pieces of each distinct pre-token once and answers every batch that named it.
3. Answers and postings meet by batch and are summed per document.

A pre-token that stands in a third of all documents is named once per batch, not once per document, so no
bucket grows with the number of documents that share a pre-token.

Defined cases: null text counts as empty; an empty text has 0 bytes and 0 tokens; each row gives one row,
repeated ids and null ids included; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pack, pack_strings, shuffle_partitions, slices, tidy, unpack, unpack_strings

#: Text of a batch in bytes. Larger batches name a shared pre-token fewer times.
BATCH_BYTES = 12_000_000
#: Text of a bucket in bytes, on average at most: what a task holds does not grow with the input.
BUCKET_BYTES = 16_000_000


class PieceCounter:
    """Pre-tokens and their piece counts for a byte-level BPE file of the tokenizers library."""

    #: Fixed value: the split that byte-level BPE files of this family use before merges.
    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE files without a normaliser or prefix space are supported")
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(self.SPLIT).findall
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.plain: dict[str, bool] = {}
        back = {c: b for b, c in byte_characters().items()}
        known = []
        for token in spec["model"]["vocab"]:
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.find(text) == [text]:
                known.append(text)
        self.known = dict(zip(known, self.count(known)))

    def count(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def sure(self, text: str) -> bool:
        """Whether both regex engines surely class every character alike: not so for code points that are
        unassigned in the older Unicode version."""
        if text.isascii():
            return True
        seen = self.plain
        ok = True
        for c in set(text):
            known = seen.get(c)
            if known is None:
                known = seen[c] = unicodedata.category(c) != "Cn"
            ok &= known
        return ok

    def parts(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and its number of special tokens."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.find(text), 0
        out = [self.find(x) for x in self.special_split.split(text)]
        return [x for part in out for x in part], len(out) - 1


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


_PARTS = pa.schema([("route", pa.int64()), ("batch", pa.string()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_PARTS_DDL = "route long, batch string, kind int, a binary, b binary, c binary, d binary, e binary"


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part, serial = counter(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, texts = batch.column("id"), batch.column("text").to_pylist()
                local: dict[str, int] = {}
                base, sizes, named, which, often = [], [], [], [], []
                known = c.known
                for text in texts:
                    text = text or ""
                    sizes.append(len(text.encode()))
                    if not c.sure(text):  # rare: the library itself counts
                        base.append(len(c.library.encode(text, add_special_tokens=False).ids))
                        named.append(0)
                        continue
                    found, total = c.parts(text)
                    before = len(which)
                    for token, times in Counter(found).items():
                        pieces = known.get(token)
                        if pieces is not None:
                            total += pieces * times
                        else:
                            which.append(local.setdefault(token, len(local)))
                            often.append(times)
                    base.append(total)
                    named.append(len(which) - before)
                # a recomputed partition reads the same splits, so its batches and keys are the same; the sum makes sure
                key = f"{part}-{serial}-{zlib.crc32(np.array(sizes + base, np.int64).tobytes())}"
                serial += 1
                rows = [(
                    buckets + zlib.crc32(key.encode()) % buckets, key, 0,
                    pack(ids.fill_null(0).to_numpy()), pack(np.array([sizes, base, named], np.int64).ravel()), pack(np.array(which, np.uint32)), pack(np.array(often, np.uint32)),
                    pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                )]
                strings = [x.encode() for x in local]
                of = np.fromiter((zlib.crc32(x) % buckets for x in strings), np.int64, len(strings))
                order = np.argsort(of, kind="stable")
                edges = np.flatnonzero(np.diff(of[order])) + 1
                for group in np.split(order, edges) if len(order) else []:
                    rows.append((int(of[group[0]]), key, 1, pack(group.astype(np.uint32)), pack_strings([strings[i] for i in group]), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PARTS.types)], schema=_PARTS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, asked, distinct = counter(path), [], {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield pa.RecordBatch.from_pylist([row], schema=_PARTS)
                else:
                    strings = unpack_strings(row["b"])
                    asked.append((row["batch"], row["a"], np.fromiter((distinct.setdefault(x, len(distinct)) for x in strings), np.int64, len(strings))))
        if not asked:
            return
        names = [x.decode() for x in distinct]
        pieces = np.empty(len(names), np.uint32)
        for lo in range(0, len(names), 20_000):
            pieces[lo : lo + 20_000] = c.count(names[lo : lo + 20_000])
        for key, where, index in asked:
            row = {"route": 0, "batch": key, "kind": 2, "a": where, "b": pack(pieces[index]), "c": None, "d": None, "e": None}
            yield pa.RecordBatch.from_pylist([row], schema=_PARTS)

    out = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[str, list]]:
            """The rows of one batch at a time; they come in order of batches."""
            kept: list = []
            for batch in batches:
                for row in batch.to_pylist():
                    if kept and row["batch"] != kept[0]["batch"]:
                        yield kept[0]["batch"], kept
                        kept = []
                    kept.append(row)
            if kept:
                yield kept[0]["batch"], kept

        for key, rows in whole():
            head = next(r for r in rows if r["kind"] == 0)
            sizes, base, named = unpack(head["b"]).reshape(3, -1)
            which, often = unpack(head["c"]), unpack(head["d"])
            pieces = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
            for r in rows:
                if r["kind"] == 2:
                    pieces[unpack(r["a"])] = unpack(r["b"])
            if not pieces.all():  # every pre-token has a piece
                raise ValueError(f"batch {key}: pre-tokens without an answer")
            doc = np.repeat(np.arange(len(named)), named)
            total = base + np.bincount(doc, weights=pieces[which] * often, minlength=len(named)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unpack(head["a"]), pa.int64(), mask=unpack(head["e"]).astype(bool)), pa.array(sizes), pa.array(total)], schema=out)

    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(split), _PARTS_DDL)
    answered = parts.repartition(buckets, "route").mapInArrow(tidy(answer), _PARTS_DDL)
    counted = answered.repartition(buckets, "batch").sortWithinPartitions("batch").mapInArrow(tidy(add_up), "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

