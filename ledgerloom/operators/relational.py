"""Operators that other operators are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def hash_order(*cs: Column | str) -> Column:
    """A fixed random order: SHA-256 of the parts."""
    return F.sha2(F.concat_ws("|", *cs), 256)


def top_n_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, rank: str | None = None) -> DataFrame:
    """First n rows by key. Spark limits groups before the shuffle where n is a number."""
    out = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= n)
    return out.withColumnRenamed("__rank", rank) if rank else out.drop("__rank")


def kept(df: DataFrame) -> DataFrame:
    """A reliable copy in the shared folder, which cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, "kept")
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._kept_at = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def last_before(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Rows with the last ``value`` that is not null, up to themselves in the order of columns, by key.

    Rows are sorted over all tasks, so a key with many rows lies in several. Within a task a window finds the last value;
    those of the tasks before come from a window over one row a task and key.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    by = [*keys, *order]
    placed = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__task": F.spark_partition_id(), "__place": place}))
    ends = placed.groupBy("__task", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__place"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__ahead", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    within = Window.partitionBy("__task", *keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("__own", F.last(value, ignorenulls=True).over(within)).join(ends, ["__task", *keys])
    return out.withColumn(name, F.coalesce("__own", "__ahead")).drop("__task", "__place", "__own", "__ahead")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """Rows with their numbers from 1 by key, in the order of columns; no key is held by one task.

    Rows are sorted over all tasks and written with their places. Only the numbers of rows by task and key go through a
    window, which gives each task its offset. Rows that are equal in ``order`` should be equal in all columns.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    by = [*keys, *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = kept(sorted_.withColumns({"__task": F.spark_partition_id(), "__place": place}))
    counts = placed.groupBy("__task", *keys).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    out = placed.join(offsets, ["__task", *keys])
    return out.withColumn(name, F.col("__ahead") + F.col("__place") - F.col("__first") + 1).drop("__task", "__place", "__ahead", "__first")


def running_sums(rows: DataFrame, keys: Sequence[str], place: str, columns: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Columns replaced by their sums up to a row's place (from 1), by key. Places are cut into blocks: windows hold one
    block of a key, or the sums of its blocks."""
    out = rows.withColumn("__block", F.floor((F.col(place) - 1) / block))
    sums = out.groupBy(*keys, "__block").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumns({f"__{c}": F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)) for c in columns})
    within = Window.partitionBy(*keys, "__block").orderBy(place)
    out = out.join(ahead, [*keys, "__block"])
    return out.withColumns({c: F.sum(c).over(within) + F.col(f"__{c}") for c in columns}).drop("__block", *(f"__{c}" for c in columns))


def with_summary(rows: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    """Rows with aggregates over their key: partial sums and a join in place of a window that holds all rows of a key."""
    return rows.join(rows.groupBy(*keys).agg(*(c.alias(n) for n, c in columns.items())), list(keys))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row by key, the first in the order."""
    return top_n_per_group(rows, keys, order, 1)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], created: str = "created_at") -> DataFrame:
    """Updates replace rows with equal keys; the time of creation stays that of the first."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    out = both.withColumn(created, F.min(created).over(w)).withColumn("__rank", F.row_number().over(w.orderBy(F.desc("__new"))))
    return out.where("__rank = 1").drop("__rank", "__new")


def with_fallback(primary: DataFrame, backup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the primary, and those of the backup whose key the primary lacks."""
    return primary.unionByName(backup.join(primary.select(*keys).distinct(), list(keys), "left_anti"))


def union_priority(parts: Sequence[tuple[DataFrame, Column]], keys: Sequence[str]) -> DataFrame:
    """Union of parts in which an earlier part wins by key; within a part the given order decides."""
    out = None
    for i, (df, order) in enumerate(parts):
        part = df.withColumn("__part", F.lit(i)).withColumn("__order", order.cast("string"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return keep_first(out, keys, [F.col("__part"), F.col("__order")]).drop("__part", "__order")
