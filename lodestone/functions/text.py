"""Text analysis: portable tokens, stop words, stemmers, n-grams, highlights, chunkers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning for search.
STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what when where who which why how all each every both few "
    "more most other some such no nor not only own same so than too very can just should now do does did doing would could might must shall may am been being if or because until "
    "while about into through during before after above below between under again further then once here there any also"
).split()


def tokens(text: Column, min_length: int = 1, stopwords: list[str] | None = None) -> Column:
    """Lower-case runs of ASCII letters and digits that are whole words, the same in every engine."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    found = F.filter(parts, lambda t: t.rlike("^[a-z0-9]+$") & (F.length(t) >= min_length))
    if stopwords:
        words = F.array(*[F.lit(w) for w in stopwords])
        found = F.filter(found, lambda t: ~F.array_contains(words, t))
    return found


def search_tokens(text: Column) -> Column:
    """Tokens of the keyword index: longer than two characters, no stop words."""
    return tokens(text, 3, STOPWORDS)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# ---------------------------------------------------------------- stemmers
# Fixed values of the stemmer's steps: suffix and replacement, tried in this order.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_PAIRS2, _PAIRS3 = ([tuple(p.split(" ")) for p in s.split(",")] for s in (_STEP2, _STEP3))
_CVC = re.compile(r"[^aeiou][aeiou][^aeiouwxy]$")
_VC = re.compile(r"[aeiou]+[^aeiou]+")


def measure(stem: str) -> int:
    """Vowel-consonant groups; only aeiou are vowels."""
    return len(_VC.findall(stem))


def _swap(word: str, pairs: list[tuple[str, str]]) -> str:
    """The first suffix whose stem has a measure is replaced."""
    for suffix, other in pairs:
        if word.endswith(suffix) and measure(word[: -len(suffix)]):
            return word[: -len(suffix)] + other
    return word


def _after_ed(stem: str) -> str:
    if stem[-2:] in ("at", "bl", "iz"):
        return stem + "e"
    if re.search(r"([^aeioulsz])\1$", stem):
        return stem[:-1]
    return stem + "e" if measure(stem) == 1 and _CVC.search(stem) else stem


def porter(word: str) -> str:
    """A five-step suffix stemmer; words of up to two letters stay as they are."""
    word = word.lower()
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if re.search("[aeiou]", word[: -len(suffix)]):
                    word = _after_ed(word[: -len(suffix)])
                break
    if word.endswith("y") and re.search("[aeiou]", word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _PAIRS2), _PAIRS3)
    for suffix in _STEP4:
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
            word = stem
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _CVC.search(word[:-1]):
            return word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def porter_udf(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of each distinct term: the stemmer runs on the vocabulary, not on the text."""
    vocabulary = terms.select(column).distinct()
    return vocabulary.withColumn("stem", porter_udf(F.col(column)))


# Suffixes of the light stemmer, tried in this order.
LIGHT_SUFFIXES = "ization ational fulness ousness iveness ation eness ment ness ible able ity ing ies ive ion ous ful ism ist ly ed er es al s".split()


def light_stem(word: Column, suffixes: list[str] = LIGHT_SUFFIXES, least: int = 3) -> Column:
    """The word in lower case without the first suffix of the list that leaves at least `least` characters."""
    word = F.lower(word)
    out = F.when(F.lit(False), word)
    for s in suffixes:
        out = out.when(word.endswith(s) & (F.length(word) - len(s) >= least), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def rule_stem(word: Column) -> Column:
    """Single-suffix rules: doubled letters before -ing go, -ies becomes y, -tion becomes t."""
    w, n = F.lower(word), F.length(word)

    def cut(k: int, tail: str = "") -> Column:
        return F.concat(F.substring(w, F.lit(1), n - k), F.lit(tail))

    # (suffix, shorter words stay, letters cut, tail)
    ing = F.when((n > 5) & (F.substring(w, n - 3, F.lit(1)) == F.substring(w, n - 4, F.lit(1))), cut(4)).when(n > 5, cut(3)).otherwise(w)
    out = F.when(w.endswith("ing"), ing)
    for suffix, longer, k, tail in (("ed", 4, 2, ""), ("ly", 4, 2, ""), ("ies", 4, 3, "y"), ("es", 4, 2, "")):
        out = out.when(w.endswith(suffix), F.when(n > longer, cut(k, tail)).otherwise(w))
    out = out.when(w.endswith("s") & ~w.endswith("ss"), F.when(n > 3, cut(1)).otherwise(w))
    for suffix, longer, k, tail in (("tion", 5, 4, "t"), ("ment", 5, 4, ""), ("ness", 5, 4, ""), ("able", 5, 4, ""), ("ible", 5, 4, "")):
        out = out.when(w.endswith(suffix), F.when(n > longer, cut(k, tail)).otherwise(w))
    return out.otherwise(w)


def analyze(text: Column, min_length: int = 1, stopwords: list[str] | None = None, stem: bool = False, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Tokens, without stop words, stemmed, each followed by its synonyms."""
    out = tokens(text, min_length, stopwords)
    if stem:
        out = F.transform(out, light_stem)
    if synonyms:
        entries = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
        out = F.flatten(F.transform(out, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(entries, t), F.array().cast("array<string>")))))
    return out


def keyword(text: Column) -> Column:
    return F.array(F.lower(strip(text)))


def char_ngrams(text: Column, low: int = 2, high: int = 3) -> Column:
    """#gram# of every word of lower-case letters, for all sizes from low to high."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 0)

    def sized(w: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.concat(F.lit("#"), F.substring(w, i, F.lit(n)), F.lit("#")))
        return F.when(F.length(w) >= n, parts).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*[sized(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, grams))


def text_id(text: Column) -> Column:
    """The first 12 hex digits of the text's MD5."""
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def hashed_terms(text: Column, size: int) -> Column:
    """Map of term hash modulo size to ln(1 + frequency); equal in every process."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(slots), lambda s: F.struct(s, F.log1p(F.size(F.filter(slots, lambda x: x == s)).cast("double")))))


def highlights(text: Column, terms: list[str], max_length: int = 150, most: int = 3) -> Column:
    """Up to `most` sentences that hold a term, cut at max_length."""
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hit = F.filter(F.split(text, r"[.!?]+"), lambda s: F.arrays_overlap(search_tokens(s), wanted))
    return F.slice(F.transform(hit, lambda s: F.when(F.length(s) > max_length, F.concat(F.substring(strip(s), 1, max_length), F.lit("..."))).otherwise(strip(s))), 1, most)


def summary(text: Column, max_length: int = 200) -> Column:
    """The first sentence if it fits, else the text cut at max_length."""
    first = F.regexp_extract(strip(text), r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when((first != "") & (F.length(first) <= max_length), first).when(F.length(strip(text)) <= max_length, strip(text)).otherwise(F.concat(F.substring(strip(text), 1, max_length), F.lit("...")))


# ---------------------------------------------------------------- chunkers
def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Chunks of up to size characters: pieces of the first separator that makes all of them fit, merged greedily;
    each chunk begins with up to overlap characters of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    pieces, joiner = [text], ""
    for sep in separators:
        pieces, joiner = (text.split(sep), sep) if sep else ([text[i : i + size] for i in range(0, len(text), size)], "")
        if all(len(p) <= size for p in pieces):
            break
    out: list[str] = []
    current = ""
    for piece in pieces:
        joined = current + joiner + piece if current else piece
        if len(joined) <= size:
            current = joined
            continue
        if current.strip():
            out.append(current)
        tail = current[-overlap:] if overlap else ""
        current = tail + joiner + piece if tail and len(tail) + len(joiner) + len(piece) <= size else piece
    if current.strip():
        out.append(current)
    return out


def split_sentences(text: str, size: int = 1000, overlap: int = 50) -> list[str]:
    """Windows of size characters that end at a sentence in their second half, if there is one; always advances."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            stops = [m.end() for m in re.finditer(r"[.!?]\s", text[at + size // 2 : end])]
            end = at + size // 2 + stops[-1] if stops else end
        if text[at:end].strip():
            out.append(text[at:end].strip())
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def split_headings(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[str, int, str]]:
    """(heading, level, chunk) for markdown sections; text before the first heading has none."""
    marks = list(re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M))
    edges = [("", 0, 0, marks[0].start() if marks else len(text))]
    edges += [(m[2].strip(), len(m[1]), m.end(), n.start() if n else len(text)) for m, n in zip(marks, [*marks[1:], None])]
    return [(h, level, c) for h, level, a, b in edges for c in split_recursive(text[a:b].strip(), size, overlap)]


CHUNKERS = {"recursive": split_recursive, "sentence": split_sentences}


def chunk(docs: DataFrame, id_col: str, text_col: str, method: str = "recursive", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, position, chunk) of every text. Null or blank texts have no chunks."""
    split = CHUNKERS[method]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split(t, size, overlap) if t else [])

    return docs.select(id_col, F.posexplode(run(F.col(text_col))).alias("position", "chunk"))


def heading_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, position, heading, level, chunk) of markdown texts."""

    @F.pandas_udf("array<struct<heading:string,level:int,chunk:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"heading": h, "level": n, "chunk": c} for h, n, c in split_headings(t, size, overlap)] if t else [])

    return docs.select(id_col, F.posexplode(run(F.col(text_col))).alias("position", "s")).select(id_col, "position", "s.*")


# ---------------------------------------------------------------- vectors and triplets out of text
def hash_vector(text: Column, size: int) -> Column:
    """A vector of unit length that depends on the text alone, for tests without a model: part i is the first eight hex
    digits of md5(text:i), from -1 to 1. Null for null."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2147483647.5 - 1)
    length = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(text.isNotNull(), F.transform(parts, lambda x: x / length))


def triplets(text: Column) -> Column:
    """Structs (head, relation, tail) of relation markup: <triplet> head <subj> relation <obj> tail, repeated; incomplete
    ones are left out."""
    clean = F.regexp_replace(text, r"</?s>|<pad>", "")
    found = F.filter(F.split(clean, "<triplet>"), lambda x: x.rlike(r"(?s)^[^<]*\S[^<]*<subj>[^<]*\S[^<]*<obj>[^<]*\S"))
    part = lambda x, pattern: F.trim(F.regexp_extract(x, pattern, 1))
    return F.transform(found, lambda x: F.struct(part(x, r"^([^<]*)<subj>").alias("head"), part(x, r"<subj>([^<]*)<obj>").alias("relation"), part(x, r"<obj>([^<]*)").alias("tail")))
