"""What several operators share: tables, identities, the shared folder, writes between steps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Stands for a null doc_id inside an operator: after all others.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + column.replace("`", "``") + "`")


def identity(column: str = "doc_id") -> Column:
    """The row's integer identity; null becomes the largest."""
    return F.coalesce(named(column).cast("long"), F.lit(NULL_ID))


# Columns that an operator only passes on travel in one struct named `own`, whose fields have
# neutral names: whatever a table's columns are called, none meets a column of the operator.


def own(columns: list[str]) -> Column:
    return F.struct(*([named(c).alias(f"c{i}") for i, c in enumerate(columns)] or [F.lit(0).alias("none")])).alias("own")


def with_own(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """The schema of `own` and then these columns."""
    held = df.select(own(columns)).schema["own"]
    return StructType([StructField("own", held.dataType, True), *_parse_datatype_string(ddl).fields])


def restored(df: DataFrame, columns: list[str], **instead: Column) -> list[Column]:
    """The columns of the table in their order: those in `own` as they were, others from `instead`."""
    held = {c: F.col(f"own.c{i}") for i, c in enumerate(x for x in columns if x not in instead)}
    return [(held[c] if c in held else instead[c].cast(df.schema[c].dataType)).alias(c) for c in columns]


def text_of(column: str) -> Column:
    return named(column).cast("string").alias("text")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of this process if Spark is local."""
    context = spark.sparkContext._jsc.sc()
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="curvelens-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{own}")
        return context.getCheckpointDir().get()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(named(column).cast("string"))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def power_of_two(n: float) -> int:
    return 1 << max(0, int(max(n, 1) - 1).bit_length())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, read by column, no lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    for paths in _RECORDED:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(value: Column, cuts: list[int]) -> Column:
    """How many cuts are below the value: a binary search as nested conditions."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(value <= cuts[mid], place(value, cuts[:mid])).otherwise(place(value, cuts[mid + 1 :]) + mid + 1)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: a side is broadcast only if Spark measures it below its threshold."""
    return left.join(right, on, how)


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of any object; its classes travel with it, as those of functions do."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast: Broadcast):
    """What was shared: unpacked once in a worker, which then lets go of the bytes."""
    if not hasattr(broadcast, "_opened"):
        broadcast._opened = cloudpickle.loads(broadcast.value)
        broadcast.__dict__.pop("_value", None)
    return broadcast._opened


@contextlib.contextmanager
def trimmed():
    """What was freed meanwhile goes back to the system at the end, as workers live on."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """The same Arrow pass, trimmed when it ends."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with trimmed():
            yield from run(batches)

    return passes


#: Rows of an Arrow batch where rows are whole texts: Spark's default of 10,000 makes batches of tens of megabytes.
TEXT_ROWS = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches become small, unless it has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name, "10000") == "10000":
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


#: Lists that note which tables are stored while they are here.
_RECORDED: list[list[str]] = []


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Notes the tables that are stored meanwhile, so that they can go once they are of no more use."""
    _RECORDED.append(paths)
    try:
        yield
    finally:
        _RECORDED.remove(paths)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()
