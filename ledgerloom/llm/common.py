"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    context = spark.sparkContext
    set_to = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not set_to:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        context.setCheckpointDir(set_to)
    return set_to


#: Rows for which a task is worth its start and its file, where a table's rows are known to be few.
TASK_ROWS = 50_000


def fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, all of it, in no more tasks than about ``rows`` rows need: one for ``TASK_ROWS``, and two a core at least."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts lineage with a table in the shared folder, of about ``rows`` rows. Dataset.checkpoint would compute the rows twice."""
    return written(df if rows is None else fewer_tasks(df, rows), "checkpoint")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Writes a table of its own to the shared folder and reads it again."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that holds more than one in so many rows is dealt over several tasks.
PARTS = 1000
#: Keys of fewer rows are never split.
FEW = 1000


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys that a join should deal over several tasks, with the number of tasks; None where there are none.

    ``counts`` has each key with its number of rows ``n``. A key with more than one in ``PARTS`` of all rows is hot, so
    there are fewer than ``PARTS`` of them, which bounds what is broadcast.
    """
    row = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    if not row["most"] or row["most"] < FEW or row["most"] * PARTS <= row["total"]:
        return None
    hot = counts.where((F.col("n") * PARTS > row["total"]) & (F.col("n") >= FEW))
    return checkpoint(hot.select(key, F.ceil(F.col("n") * PARTS / row["total"]).cast("int").alias("__parts")))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` where rows of ``left`` with a hot key are dealt by a hash of the column ``spread``.

    Rows of ``right`` with such a key are repeated for each task: fewer than ``2 * PARTS`` repeats in all, if ``right``
    has each key once.
    """
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    repeated = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Appends columns that Python computes from Arrow batches, a batch at a time.

    ``make`` is called once a task and returns a function from the Python lists of ``inputs`` to one
    list of values for each field. A column of ``df`` with a field's name is replaced.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = _arrow_schema(fields)

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            step = _rows_in(batch, inputs)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = fn(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs))
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array(v, type=arrow.field(i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + new)
                del made, arrays, part
        give_back()

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch; each task holds a few batches at a time, on both sides of the pipe.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, as rows may be long; a smaller bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system, as workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _rows_in(batch: pa.RecordBatch, inputs: list[str], most: int = 4 << 20) -> int:
    """Rows that hold about ``most`` bytes of input."""
    size = sum(batch.column(batch.schema.get_field_index(c)).nbytes for c in inputs)
    return max(1, min(batch.num_rows or 1, int(batch.num_rows * most / max(size, 1))))


def _arrow_schema(fields: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(fields))


def as_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and text alone; nothing else of a table reaches an operator, so clashing names do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows of at most 16 bytes that may be sent to all executors; beyond it a join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table of few narrow columns, marked for broadcast only if its rows are counted to be few."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most else df
