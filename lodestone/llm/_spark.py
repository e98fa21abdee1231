"""Session helpers of the text operators: shared storage, worker memory, column guards."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset) one in the session's warehouse."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there.

    A lost executor costs at most the tasks that read the files again.  The
    files go when the Python process ends, or by `release(spark)`.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, and let Spark drop the shuffles behind it.

    Spark removes shuffle files once the driver's garbage collector finds their
    plans unused, which a driver with little to do would put off.
    """
    mine, spark = df._settled, df.sparkSession
    release(spark, keep=paths(spark) - {mine})
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that release() will delete."""
    path = f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def paths(spark: SparkSession) -> set[str]:
    """What settle() and new_path() have named for this session and release() has not deleted."""
    return {path for s, path in _written if s is spark}


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete what settle() wrote for this session, but for the paths to keep."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [x for x in _written if x[0] is spark and x[1] not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _written.remove(entry)


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            pass


def lean(run):
    """Wrap a function over batches: when its task ends, the worker gives free memory back to the system.

    Workers are used again by later stages; without this each would hold the most it ever needed.
    """

    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def worker_held(key, make):
    """make() once for each key in a worker process, whose later tasks get the same object (their code is made anew)."""
    home = sys.modules.setdefault("_lodestone_held", types.ModuleType("_lodestone_held"))
    held = home.__dict__.setdefault("objects", {})
    if key not in held:
        held[key] = make()
    return held[key]


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text alone (and the named extra columns), so that clashing columns never get in the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def sample_of_each(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Of each value of `group` the n rows with the smallest hashes of `key`; values of `group` are few.

    Where a value has many rows they are thinned by hash to about 2n first, so
    that the window only ever sees a bounded number of rows.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    counts = rows.groupBy(F.col(group).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    near = hashed.join(F.broadcast(counts), F.col(group) == F.col("_value"))
    near = near.where(F.pmod("_hash", F.lit(1 << 30)) * F.greatest(F.col("_rows") - 4 * n, F.lit(0)).cast("double") <= float(2 * n << 30))
    order = Window.partitionBy(group).orderBy("_hash", key)
    return near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).select(*rows.columns)


def crc_mod(column: str, n: int):
    """crc32 of a column's text modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
