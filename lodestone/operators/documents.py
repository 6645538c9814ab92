"""Document trees: headings, pages and paragraphs as nodes; paths, lookups and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, position, text, summary): blocks between blank lines; blank ones keep their number but give no node."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, r"\n\s*\n")).alias("position", "text"))
    kept = parts.select(id_col, "position", X.strip(F.col("text")).alias("text")).where("text <> ''")
    return kept.withColumn("summary", X.summary(F.col("text")))


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, page, text): parts after --- Page n --- marks; a text without marks is page 1."""
    marked = F.split(F.concat(F.lit("--- Page 1 ---\n"), F.regexp_replace(text_col, r"^\s*--- Page 1 ---\n?", "")), r"(?m)(?=^--- Page \d+ ---)")
    parts = docs.select(id_col, F.explode(marked).alias("p"))
    number = F.regexp_extract("p", r"^--- Page (\d+) ---", 1)
    return parts.where(number != "").select(id_col, number.cast("int").alias("page"), X.strip(F.regexp_replace("p", r"^--- Page \d+ ---", "")).alias("text"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, position, level, title, text, parent): one node a markdown heading with its text up to the next one; the
    parent is the nearest heading before it of a smaller level. Text before the first heading has no node."""
    parts = docs.select(id_col, F.posexplode(F.split(F.concat(F.lit("\n"), text_col), r"\n(?=#{1,6}[ \t])")).alias("position", "p"))
    head = F.regexp_extract("p", r"^(#{1,6})[ \t]+([^\n]*)", 1)
    nodes = parts.where(head != "").select(
        id_col, "position", F.length(head).alias("level"), X.strip(F.regexp_extract("p", r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("title"),
        X.strip(F.regexp_replace("p", r"^#{1,6}[ \t]+[^\n]*\n?", "")).alias("text"),
    )
    # the last earlier position of every smaller level; the latest of those is the parent
    before = Window.partitionBy(id_col).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > n, F.max(F.when(F.col("level") == n, F.col("position"))).over(before)) for n in range(1, 6)]
    return nodes.withColumn("parent", F.greatest(*last))


def section_paths(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc, position, path): titles from the root to each section, by one join a level."""
    up = nodes.select(id_col, F.col("position").alias("up"), F.col("title").alias("up_title"), F.col("parent").alias("up_parent"))
    walk = nodes.select(id_col, "position", F.array("title").alias("path"), F.col("parent").alias("at"))
    for _ in range(5):  # headings have six levels
        walk = walk.join(up, [F.col("at") == F.col("up"), walk[id_col] == up[id_col]], "left").select(
            walk[id_col], "position", F.when(F.col("up").isNotNull(), F.concat(F.array("up_title"), "path")).otherwise(F.col("path")).alias("path"), F.col("up_parent").alias("at")
        )
    return walk.select(id_col, "position", "path")


def node_chunks(nodes: DataFrame, id_col: str = "doc_id", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc, number, position, chunk): chunks of all nodes with text, numbered within the document."""
    filled = nodes.where(X.strip(F.col("text")) != "")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: X.split_recursive(t, size, overlap))

    parts = filled.select(id_col, "position", F.posexplode(run("text")).alias("i", "chunk"))
    return parts.withColumn("number", F.row_number().over(Window.partitionBy(id_col).orderBy("position", "i")) - 1).select(id_col, "number", "position", "chunk")


def changed(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose content hash is new: those that an idempotent index has to rebuild. known: (doc, hash)."""
    hashed = docs.withColumn("hash", F.md5(F.col(text_col).cast("binary")))
    return hashed.join(known.select(id_col, "hash"), [id_col, "hash"], "left_anti")


def find_section(nodes: DataFrame, title: str, id_col: str = "doc_id") -> DataFrame:
    """The first section of each document with this title, in any case."""
    by = Window.partitionBy(id_col).orderBy("position")
    return nodes.where(F.lower("title") == title.lower()).withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def catalogue(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of a table of tree nodes: id, number of nodes, and of top nodes."""
    return nodes.groupBy(id_col).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("parent").isNull()).alias("n_top"))


def exists(nodes: DataFrame, key, id_col: str = "doc_id") -> bool:
    return not nodes.where(F.col(id_col) == F.lit(key)).isEmpty()


def delete(nodes: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """nodes without the documents listed in ids."""
    return nodes.join(ids.select(id_col), id_col, "left_anti")


def children(nodes: DataFrame, parents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Nodes whose parent is among parents (id, position)."""
    return nodes.join(parents.select(id_col, F.col("position").alias("parent")), [id_col, "parent"], "left_semi")
