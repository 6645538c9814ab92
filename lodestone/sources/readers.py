"""Readers for vector and text files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".npy": "npy"}


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON array, or one object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """All columns as text; without a header they are col_0, col_1, ..."""
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False)
    return df if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns))])


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of .npy matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                matrix = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float32)
                for lo in range(0, len(matrix), 10_000):
                    part = matrix[lo : lo + 10_000]
                    yield pd.DataFrame({"path": name, "row": np.arange(lo, lo + len(part)), "vector": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, vector array<float>")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: title (file stem), doc_type, text, source_path, size, modified."""
    df = spark.read.option("wholetext", True).text(path).select("value", "_metadata")
    name, suffix = F.col("_metadata.file_name"), F.lower(F.regexp_extract("_metadata.file_name", r"\.([^.]*)$", 1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix.isin("md", "markdown"), "markdown").otherwise("text")
    return df.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), kind.alias("doc_type"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_vectors(spark: SparkSession, path: str, file_format: str = "auto", id_field: str = "id", vector_field: str = "vector", text_field: str = "text") -> DataFrame:
    """Points (id, vector, text, metadata as JSON) of a file by its suffix; rows without a vector are left out."""
    kind = next((v for k, v in FORMATS.items() if path.lower().endswith(k)), "jsonl") if file_format == "auto" else file_format
    if kind == "npy":
        return read_npy(spark, path).select(F.col("row").cast("string").alias("id"), "vector", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("metadata"))
    df = {"jsonl": read_jsonl, "json": read_json_array, "csv": read_csv, "parquet": read_parquet}[kind](spark, path)
    vector = F.col(vector_field)
    if isinstance(df.schema[vector_field].dataType, T.StringType):
        vector = F.from_json(vector, "array<float>")
    rest = [c for c in df.columns if c not in (id_field, vector_field, text_field)]
    key = F.col(id_field).cast("string") if id_field in df.columns else F.monotonically_increasing_id().cast("string")
    text = F.col(text_field).cast("string") if text_field in df.columns else F.lit(None).cast("string")
    metadata = F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")
    return df.select(key.alias("id"), vector.cast("array<float>").alias("vector"), text.alias("text"), metadata.alias("metadata")).where(F.col("vector").isNotNull())


def write_points(points: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = points.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
