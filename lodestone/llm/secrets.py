"""Secret scans (operator 5): base patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax: name, separator (=, :=, :, =>), value. Names may be quoted or
dotted; names and values have any length. Values are quoted literals, bare words, references to names bound before, ${name} and joins of those by
plus signs. Constants propagate: a literal bound to a harmless name is scored again under the sensitive name
that it reaches; weights pass from names to what they refer to, so texts that refer to themselves cost no more. A literal is reported (kind lexed) if its target name and its own shape score high enough
together and base spans do not cover all of it.

Every text is a row of its own and nothing is shuffled. Defined cases: null text is empty; rows with repeated
or null ids are rows like any other; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, slices, tidy

KINDS = ("assign", "access", "hex", "lexed")


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# Fixed values of the contract: keywords in either ASCII case, 6+ value characters, 20+ and 24+ characters.
_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Parts of names that make a target sensitive, with weights; words that mark a placeholder.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "bearer": 0.8, "key": 0.5, "pin": 0.4, "salt": 0.4}
QUALIFIERS = {"api": 0.5, "access": 0.5, "private": 0.5, "secret": 0.5, "signing": 0.5, "encryption": 0.5, "master": 0.3, "client": 0.3, "db": 0.2}
PLACEHOLDERS = re.compile(r"(?i)(?:x+|\*+|none|null|true|false|example.*|changeme|placeholder|your[_-].*|todo|redacted|<.*>|\$\{.*\}|%\w+%)")
#: Least product of name weight and literal shape for a report.
LEAST = 0.45

_SEPARATOR = re.compile(r":=|=>|(?<![=!<>:])=(?!=)|(?<!:):(?![:/])")
# A name before a separator, read backwards from it: no separator can stand in a name, so no character is read twice.
_NAME = re.compile(r"""[ \t]*+(["']?)([\w.\-\[\]]++)""", re.ASCII)
_FIRST = re.compile(r"[A-Za-z_]")
_TERM = re.compile(r"""[ \t]*+(?:(?:[rbfu]{0,2})(?P<q>["'`])(?P<text>(?:\\.|(?!(?P=q))[^\\\n])++)(?P=q)|\$\{?(?P<env>[A-Za-z_]\w*+)\}?|(?P<bare>[^\s"'`,;#(){}\[\]+]))""", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]+]++""", re.ASCII)
_REFERENCE = re.compile(r"[A-Za-z_][\w.]*+", re.ASCII)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`$A-Za-z_])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    weight = max([SENSITIVE.get(w, 0.0) for w in [*parts, *joined]], default=0.0)
    return min(1.0, weight + max([QUALIFIERS.get(w, 0.0) for w in parts], default=0.0)) if weight else 0.0


def literal_shape(literal: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: length, entropy, mix of character classes."""
    return 0.0 if len(literal) < 6 or PLACEHOLDERS.fullmatch(literal) else _shape(len(literal), Counter(literal))


def _shape(n: int, counts: Counter) -> float:
    """literal_shape of n characters from how often each occurs."""
    used = "".join(counts)
    if re.search(r"\s", used):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(bool(re.search(p, used)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return min(1.0, 0.25 * min(entropy, 4) / 4 + 0.25 * min(n, 20) / 20 + 0.25 * min(classes, 3) + (0.0 if classes > 1 else -0.25))


def bindings(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, spans of its literals, names that it refers to) for every assignment, in order. A bare word that holds
    a separator begins an assignment of its own, which takes what is joined after it; so each join is read once."""
    back, n = text[::-1], len(text)
    run, joined = (0, 0, 0, 0), {}  # of bare words: start, end, end without points and colons, end of the last separator

    def bare_run(start: int) -> tuple[int, int, int, int]:
        end = cut = _BARE.match(text, start).end()
        while cut > start and text[cut - 1] in ".:":
            cut -= 1
        return start, end, cut, max((x.end() for x in _SEPARATOR.finditer(text, start, end)), default=-1)

    for m in _SEPARATOR.finditer(text):
        left = _NAME.match(back, n - m.start())
        if not left:
            continue
        begin, end = n - left.end(2), n - left.start(2)
        first = _FIRST.search(text, begin, end)
        if not first or left[1] and (first.start() > begin or text[begin - 1 : begin] != left[1]):
            continue
        spans, names, at = [], [], m.end()
        while term := _TERM.match(text, at):
            if term["text"] is not None:
                spans.append(term.span("text"))
            elif term["env"]:
                names.append(term["env"])
            else:
                start = term.start("bare")
                if at > m.end():
                    if start not in joined:
                        _, stop, cut, inner = bare_run(start)
                        joined[start] = (stop, cut, inner, text[start:cut] if _REFERENCE.fullmatch(text, start, cut) else None)
                    stop, cut, inner, word = joined[start]
                    if inner > 0:
                        break
                else:  # separators inside one run share its end
                    run = run if run[0] <= start < run[1] else bare_run(start)
                    stop, cut, inner = run[1], max(start, run[2]), run[3]
                    word = text[start:cut] if _REFERENCE.fullmatch(text, start, cut) else None
                if word:
                    names.append(word)
                spans.append((start, cut))
                if inner > start:
                    break
            more = _JOIN.match(text, stop if term["bare"] else term.end())
            if not more:
                break
            at = more.end()
        yield text[first.start() : end], spans, names


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text:
        return []
    last: tuple[int, int, Counter] = (0, 0, Counter())
    shapes: dict[tuple[int, int], float] = {}

    def shape(a: int, b: int) -> float:
        """literal_shape of a span; spans that end together are counted once."""
        nonlocal last
        if (a, b) not in shapes:
            shapes[a, b] = 0.0
            if b - a >= 6 and not PLACEHOLDERS.fullmatch(text, a, b):
                if b != last[1]:
                    counts = Counter(text[a:b])
                else:
                    counts = last[2] - Counter(text[last[0] : a]) if a >= last[0] else last[2] + Counter(text[a : last[0]])
                last = (a, b, counts)
                shapes[a, b] = _shape(b - a, counts)
        return shapes[a, b]

    # a binding keeps its own literals and the bindings that it refers to, never copies of theirs
    own: list[list[tuple[int, int]]] = []
    refers: list[set[int]] = []
    weights: list[float] = []
    bound: dict[str, int] = {}
    for name, spans, names in bindings(text):
        known = {n for n in names if n in bound}  # a reference, not a literal: the bare word itself is dropped
        longest = max(map(len, known), default=0)
        own.append([s for s in spans if s[1] - s[0] > longest or text[s[0] : s[1]] not in known] if known else spans)
        refers.append({bound[n] for n in known})
        weights.append(name_weight(name))
        bound[name] = len(own) - 1
    found: set[tuple[int, int]] = set()
    for i in range(len(own) - 1, -1, -1):  # references point back, so a weight is final when its turn comes
        weight = weights[i]
        if weight:
            for j in refers[i]:
                weights[j] = max(weights[j], weight)
            found |= {s for s in own[i] if weight * shape(*s) >= LEAST}
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and lexed spans together; lexed ones unless base spans cover all of them."""
    base = base_spans(text)
    covered: list[list[int]] = []  # base spans joined where they meet
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    extra = []
    for a, b in lexed_spans(text):
        i = bisect.bisect_right(covered, a, key=lambda c: c[0]) - 1
        if i < 0 or covered[i][1] < b:
            extra.append((a, 3, b))
    return base, sorted(base + extra) if extra else base


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed."""
    schema = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_lexed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "")
                kinds = Counter(k for _, k, _ in every)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), kinds[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types[1:]))], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mark; all other columns as they are. Null texts stay null."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for a, _, b in all_spans(text)[1]:
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join(out) + text[last:] if last else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 4 * CHUNK_BYTES):  # what goes out is small, too
                column = pa.array([clean(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(tidy(run), schema)
