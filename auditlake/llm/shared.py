"""Tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH, BYTES_PER_BATCH = "512", "8m"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of its limit up to which the driver's heap may grow before garbage is collected between jobs.
HEAP_SHARE = 0.4
#: Bits of a bitmap of ids: so many for each id, in maps of MAP_BITS (Spark's size), MOST_MAPS (8 MB) at most.
BITS_PER_ID, MAP_BITS, MOST_MAPS = 16, 1 << 15, 1 << 11


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on one machine where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once and read back: later jobs neither recompute them nor lose them with an executor.

    Nothing reads the shuffles of the write again, so their files go when it ends; so does what
    planning and scheduling it left on the driver, where that has made the heap grow.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    collect_driver(spark)
    return spark.read.schema(rows.schema).parquet(path)


def release(rows: DataFrame) -> None:
    """Deletes a table of written() once all that was made of it is written too."""
    files = rows.inputFiles()
    if files:
        jvm, spark = rows.sparkSession._jvm, rows.sparkSession
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def screened(rows: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """`rows` with a column `name`: false only where `column` is not among `ids` (one column, not null).

    It is true for all ids and for about one in BITS_PER_ID other rows, more of them beyond MOST_MAPS; so a
    join with few ids has to shuffle few rows, whatever their size. Bitmaps of the ids are broadcast.
    """
    maps = max(1, min(MOST_MAPS, -(-BITS_PER_ID * ids.count() // MAP_BITS)))

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(maps * MAP_BITS)) + 1

    number, bits, at = (f"{name}_{c}" for c in ("number", "bits", "at"))
    told = ids.select(place(F.col(ids.columns[0])).alias(at)).groupBy(F.bitmap_bucket_number(at).alias(number))
    told = told.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    rows = rows.withColumn(at, place(F.col(column)))
    rows = rows.withColumn(number, F.bitmap_bucket_number(at)).withColumn(at, F.bitmap_bit_position(at))
    rows = rows.join(F.broadcast(told), number, "left")
    byte = F.conv(F.hex(F.substring(bits, (F.col(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({at} % 8 as int))")) != 0, F.lit(False))
    return rows.withColumn(name, held).drop(number, bits, at)


def collect_driver(spark: SparkSession) -> None:
    """Collects the garbage of the driver's JVM if its heap has grown over HEAP_SHARE of its limit.

    Every job leaves plans, generated code and events behind. In a row of many short jobs the JVM
    would rather grow up to its limit, beside all it holds outside the heap, than collect them.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def collect_executors(spark: SparkSession) -> None:
    """Has every executor's JVM collect its garbage and give the heap that it does not use back to the machine.

    A JVM that has grown in shuffles keeps its heap, and what buffers outside it the garbage still holds,
    up to its limit; the Python workers of the stages that follow need memory beside it.
    """
    tasks = spark.sparkContext.defaultParallelism  # one for each core, all at once
    rows = spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    rows.write.format("noop").mode("overwrite").save()


def trim() -> None:
    """Gives the memory that this Python process does not use back to the machine."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """`run` over Arrow batches, giving unused memory back to the machine when a task ends.

    Python workers live on from stage to stage; without this each keeps the most that any stage took.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return told


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few hundred texts, so that a Python worker holds a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
