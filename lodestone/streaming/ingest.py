"""Micro-batch ingestion, synchronization and windowed metrics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.collection import upsert


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(batch: DataFrame, id_col: str = "id", order: str = "updated_at") -> DataFrame:
    """The last row of each id; of rows of the same moment the one with the greatest hash, whatever order they come in."""
    by = Window.partitionBy(id_col).orderBy(F.desc(order), F.desc(F.xxhash64(*[F.col(f.name) for f in batch.schema if f.dataType.typeName() not in ("map", "variant")])))
    return batch.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, id_col: str = "id", order: str = "updated_at", on_batch: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Upsert a stream of points into versions of a Parquet table under target (target/v=<batch>).

    A version is written from the one before it, so a batch that is run again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, id_col, order)
        before = read_versions(spark, target, number)
        merged = upsert(before, new, id_col) if before is not None else new
        merged.write.mode("overwrite").parquet(f"{target}/v={number}")
        if on_batch:
            on_batch(new, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_versions(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table that upsert_stream() writes, or the newest before a batch number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    found = [n for n in found if before is None or n < before]
    return spark.read.parquet(f"{target}/v={max(found)}") if found else None


def sync_changes(source: DataFrame, target: DataFrame, since=None, id_col: str = "id", stamp: str = "updated_at") -> DataFrame:
    """target after the source rows that are newer than since (None: than the newest of target) are upserted."""
    if since is None:
        since = target.agg(F.max(stamp)).head()[0]
    return upsert(target, latest(source.where(F.col(stamp) > F.lit(since)) if since is not None else source, id_col, stamp), id_col)


def sync_all(sources: dict[str, DataFrame], targets: dict[str, DataFrame], id_col: str = "id", stamp: str = "updated_at") -> tuple[dict[str, DataFrame], DataFrame]:
    """Full synchronization of several collections: each target becomes its source's latest rows. Gives the new targets,
    and a report (name, added, updated, removed, error); a collection that fails keeps its target and says why."""
    out, rows = dict(targets), []
    spark = next(iter(sources.values())).sparkSession
    for name, source in sources.items():
        try:
            fresh = latest(source, id_col, stamp)
            old = targets.get(name)
            if old is None:
                rows.append((name, fresh.count(), 0, 0, None))
            else:
                both = fresh.select(id_col, F.col(stamp).alias("__n")).join(old.select(id_col, F.col(stamp).alias("__o")), id_col, "full_outer")
                r = both.agg(F.count_if(F.col("__o").isNull()).alias("a"), F.count_if(F.col("__n") > F.col("__o")).alias("u"), F.count_if(F.col("__n").isNull()).alias("d")).first()
                rows.append((name, r.a, r.u, r.d, None))
            out[name] = fresh
        except Exception as failure:  # one collection's failure does not stop the others
            rows.append((name, 0, 0, 0, str(failure).splitlines()[0][:200]))
    return out, spark.createDataFrame(rows, "name string, added long, updated long, removed long, error string")


def apply_changes(target: DataFrame, changes: DataFrame, id_col: str = "id", order: str = "seq", op: str = "op") -> DataFrame:
    """Change capture: the last change of each id wins; op delete removes it, all others upsert it."""
    last = latest(changes, id_col, order)
    kept = target.join(last.select(id_col), id_col, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "delete").select(*[c for c in target.columns]))


def windowed_metrics(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str | None = "10 minutes", time_col: str = "ts", value_col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Events, sum, mean and extremes by time window; the same for streams (with a watermark) and tables."""
    frame = events.withWatermark(time_col, late) if events.isStreaming and late else events
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    v = F.col(value_col)
    out = frame.groupBy(window.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.select(F.col("w.start").alias("start"), *(by or []), "n", "total", "mean", "low", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time_col: str = "ts") -> DataFrame:
    """(key, start, end, n) of runs of events with gaps under gap."""
    out = events.groupBy(key, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
