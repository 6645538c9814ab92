"""Collections of points as tables: upsert, delete, metadata updates, paging, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.filters import compile_filter

METRICS = ("cosine", "euclidean", "dot", "manhattan")
POINT = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("sparse", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
    ]
)


def upsert(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of new replace those of old with the same id; of equal ids in new one row stays."""
    one = new.dropDuplicates([id_col])
    return old.join(one.select(id_col), id_col, "left_anti").unionByName(one, allowMissingColumns=True)


def count_new(old: DataFrame, new: DataFrame, id_col: str = "id") -> int:
    return new.select(id_col).distinct().join(old.select(id_col), id_col, "left_anti").count()


def delete(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return points.join(ids.select(id_col), id_col, "left_anti")


def get(points: DataFrame, requested: list, id_col: str = "id") -> DataFrame:
    """Rows in order of the request, with nulls for unknown ids."""
    wanted = points.sparkSession.createDataFrame(list(enumerate(requested)), f"position int, {id_col} {points.schema[id_col].dataType.simpleString()}")
    return F.broadcast(wanted).join(points, id_col, "left").orderBy("position")


def merge_metadata(points: DataFrame, changes: DataFrame, merge: bool = True, id_col: str = "id", column: str = "metadata") -> DataFrame:
    """changes (id, metadata map): new keys win over old ones, or replace the whole map."""
    joined = points.join(changes.select(id_col, F.col(column).alias("__m")), id_col, "left")
    old = F.coalesce(F.col(column), F.map_from_arrays(F.array(), F.array()).cast(points.schema[column].dataType))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("__m"), k))
    both = F.map_concat(kept, F.col("__m")) if merge else F.col("__m")
    return joined.withColumn(column, F.when(F.col("__m").isNull(), F.col(column)).otherwise(both)).drop("__m")


def page(points: DataFrame, limit: int = 100, offset: int = 0, order: str = "id") -> DataFrame:
    """A page in order of a column. Rows before it are sorted, too: pages far into a large table cost a sort of what
    comes before them; ask for rows after the last seen key instead."""
    return points.orderBy(order).offset(offset).limit(limit)


def scroll(points: DataFrame, limit: int = 100, offset: int = 0, where=None, order: str = "id") -> tuple[DataFrame, int | None]:
    """A page, filtered after paging (so it may be short), and the next offset if another row exists."""
    shown = page(points, limit, offset, order)
    more = page(points, 1, offset + limit, order).count()
    return shown.where(compile_filter(where, points.schema)) if where else shown, offset + limit if more else None


def validate(points: DataFrame, dimension: int, id_col: str = "id", vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows have a column error."""
    error = F.when(F.col(id_col).isNull(), "no id").when(F.col(vector_col).isNull(), "no vector").when(F.size(vector_col) != dimension, F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(vector_col).cast("string")))
    checked = points.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null")


class Database:
    """Collections as managed tables of one Spark schema, described by table properties."""

    def __init__(self, spark: SparkSession, schema: str = "points"):
        self.spark, self.schema = spark, schema
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")

    def _name(self, name: str) -> str:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a collection name: {name!r}")
        return f"`{self.schema}`.`{name}`"

    def has(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._name(name))

    def create(self, name: str, dimension: int, metric: str = "cosine", description: str = "", tags: list[str] | None = None) -> DataFrame:
        if self.has(name):
            raise ValueError(f"collection {name!r} exists")
        if metric not in METRICS or dimension < 1:
            raise ValueError(f"bad metric or dimension: {metric!r}, {dimension}")
        self.spark.createDataFrame([], POINT).write.format("parquet").saveAsTable(self._name(name))
        said = {"dimension": str(dimension), "metric": metric, "about": description, "tags": ",".join(tags or [])}
        pairs = ", ".join(f"'{k}' = '{v.replace(chr(39), chr(39) * 2)}'" for k, v in said.items())
        self.spark.sql(f"ALTER TABLE {self._name(name)} SET TBLPROPERTIES ({pairs})")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if not self.has(name):
            raise KeyError(name)
        return self.spark.table(self._name(name))

    def info(self, name: str) -> dict:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(name)}").collect()
        return {r["key"]: r["value"] for r in rows} | {"count": self.get(name).count()}

    def list(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema))

    def drop(self, name: str) -> bool:
        known = self.has(name)
        if known:
            self.spark.sql(f"DROP TABLE {self._name(name)}")
        return known

    def add(self, name: str, points: DataFrame) -> int:
        """Upsert points; gives the number of new ids. The table is replaced by a new one, then renamed."""
        info, old = self.info(name), self.get(name)
        good, bad = validate(points, int(info["dimension"]))
        if not bad.isEmpty():
            raise ValueError(bad.select("id", "error").head().error)
        new = count_new(old, good)
        now = F.current_timestamp()
        filled = good.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in good.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POINT])
        filled = filled.withColumn("created_at", F.coalesce("created_at", now)).withColumn("updated_at", now)
        kept = old.select("id", F.col("created_at").alias("__c"))
        filled = filled.join(kept, "id", "left").withColumn("created_at", F.coalesce("__c", "created_at")).drop("__c")
        self._replace(name, upsert(old, filled), info)
        return new

    def remove(self, name: str, ids: DataFrame) -> int:
        old, info = self.get(name), self.info(name)
        found = old.join(ids.select("id"), "id", "left_semi").count()
        self._replace(name, delete(old, ids), info)
        return found

    def _replace(self, name: str, rows: DataFrame, info: dict) -> None:
        fresh = self._name(f"{name}__next")
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        rows.write.format("parquet").saveAsTable(fresh)
        self.spark.sql(f"DROP TABLE {self._name(name)}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self._name(name)}")
        pairs = ", ".join(f"'{k}' = '{str(info.get(k, '')).replace(chr(39), chr(39) * 2)}'" for k in ("dimension", "metric", "about", "tags"))
        self.spark.sql(f"ALTER TABLE {self._name(name)} SET TBLPROPERTIES ({pairs})")
