"""Write a reduced table to the shared folder so that its size is known.

A per-key summary (newest instant per sensor, one row per camera, ...) is small in
practice, but nothing proves it before it has been computed. ``settle`` computes it once
and writes it as Parquet. Later joins are planned from what has been written. The files
outlive lost executors, and the shuffles that led to them are dropped at once.

Parquet packs equal rows into almost nothing, so file sizes say little about the memory a
broadcast takes. The rows are counted while they are written; a table whose rows, at the
width of their types, exceed ``spark.sql.autoBroadcastJoinThreshold`` is never broadcast.
"""

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugelake-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_folder(spark)}/gaugelake/{app}/{label}-{uuid.uuid4().hex}"


_guard, _within = threading.Lock(), {}


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs within lets go of its shuffle files at its end.

    The setting is the session's. Threads that settle together share it: the first one sets it, the
    last one puts it back.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    key = spark.conf.get("spark.app.id", "app")
    with _guard:
        count, before = _within.get(key, (0, None))
        if not count:
            before = spark.conf.get(name, None)
            spark.conf.set(name, "true")
        _within[key] = count + 1, before
    try:
        yield
    finally:
        with _guard:
            count, before = _within[key]
            _within[key] = count - 1, before
            if count == 1:
                spark.conf.set(name, before) if before else spark.conf.unset(name)


def together(*parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """Parts of a query that each settle tables and don't need each other, started at once."""
    in_session = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(parts)) as pool:
        started = [pool.submit(in_session(part)) for part in parts]
        return [found.result() for found in started]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once and return it as a table of known size."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    seen = Observation()
    with _shuffles_dropped(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    # Types have a default width each; a row has eight bytes besides.
    width = 8 + spark._jvm.org.apache.spark.sql.types.DataType.fromJson(df.schema.json()).defaultSize()
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table.hint("merge") if seen.get["rows"] * width > most else table


def clear_settled(spark: SparkSession) -> None:
    """Remove what this application has settled. No table that came from it may be read later."""
    app = spark.conf.get("spark.app.id", "app")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/gaugelake/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows dealt out over the cores, if the table is smaller than a split for each of them.

    For small tables in few splits whose rows take long to work on, such as documents to be parsed;
    the shuffle moves less than a split a core. Larger tables come in splits enough.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
