"""What the training-data operators share: tables, durable cuts and bounded membership filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One bitmap row covers this many bits (4 KiB); fixed by Spark's bitmap functions.
BITS_PER_ROW = 32768

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local folder does, but only if the session itself is local.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumenspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Has Spark delete a query's shuffle files at its end instead of when the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the cuts made within each ``settled`` that is under way.
_ON_THE_WAY: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors.

    The shuffles behind df go with the write: what comes later reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_cuts(*cuts: DataFrame) -> None:
    """Delete tables written by ``cut`` that no later plan reads."""
    for df in cuts:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, f)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut`` of what make returns, without the tables that were cut on the way to it."""
    _ON_THE_WAY.append([])
    try:
        df = make()
    finally:
        paths = _ON_THE_WAY.pop()
    out = cut(df, name)
    for path in paths:
        _delete(df.sparkSession, path)
    return out


# ---- memory of Python workers, which live on from task to task and from operator to operator ----

_HELD: dict[str, tuple[Any, Any]] = {}


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """One object for each owner, kept between tasks of a worker process; what other owners left goes."""
    for other in [o for o in _HELD if o != owner]:
        del _HELD[other]
    if owner not in _HELD or _HELD[owner][0] != key:
        _HELD.pop(owner, None)
        _HELD[owner] = (key, make())
    return _HELD[owner][1]


def give_back() -> None:
    """Return freed memory to the system; idle workers count against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that lets its memory go at the end; ``held`` objects of other owners go first."""

    @wraps(run)
    def wrapped(frames: Iterator) -> Iterator:
        for owner in [o for o in _HELD if o != run.__module__]:
            del _HELD[owner]
        try:
            yield from run(frames)
        finally:
            give_back()

    return wrapped


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in, which then means the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmap(keys: DataFrame, column: str, bits: int = 1 << 24) -> DataFrame:
    """A one-hash membership filter of at most bits / 8 bytes, whatever the number of keys.

    Rows: bucket, bitmap (4 KiB each), so its size bound is proven and it may be broadcast.
    """
    bit = _bit(F.col(column), bits)
    return (
        keys.select(F.expr(f"cast(pmod(xxhash64({column}), {bits}L) div {BITS_PER_ROW} as int)").alias("bm_bucket"), (bit % BITS_PER_ROW).cast("bigint").alias("bm_pos"))
        .groupBy("bm_bucket")
        .agg(F.bitmap_construct_agg("bm_pos").alias("bm_bits"))
    )


def with_membership(df: DataFrame, bitmap: DataFrame, key: Column, flag: str, bits: int = 1 << 24) -> DataFrame:
    """Add a boolean: False means the key is surely not in the filter. No shuffle of df."""
    out = df.withColumn("__bit", _bit(key, bits)).withColumn("__bucket", F.expr(f"cast(__bit div {BITS_PER_ROW} as int)"))
    out = out.join(F.broadcast(bitmap), F.col("__bucket") == F.col("bm_bucket"), "left")
    at = f"cast((__bit % {BITS_PER_ROW}) div 8 as int) + 1"
    byte = f"cast(conv(hex(substring(bm_bits, {at}, 1)), 16, 10) as int)"
    test = F.expr(f"coalesce((shiftright({byte}, cast(__bit % 8 as int)) & 1) = 1, false)")
    return out.withColumn(flag, test).drop("__bit", "__bucket", "bm_bucket", "bm_bits")


def remove_keys(df: DataFrame, dropped: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Anti-join of df with a large key set, shuffling only the rows that may match.

    Rows whose bit is unset pass straight from the scan; the rest are joined exactly. dropped holds
    the column ``key``; null keys in df are never removed.
    """
    bitmap = key_bitmap(dropped, key, bits)
    flagged = with_membership(df, bitmap, F.col(key), "__maybe", bits)
    clear = flagged.where(F.col(key).isNull() | ~F.col("__maybe")).drop("__maybe")
    doubtful = flagged.where(F.col(key).isNotNull() & F.col("__maybe")).drop("__maybe")
    gone = dropped.select(F.col(key).alias("__gone")).distinct()
    return clear.unionByName(doubtful.join(gone, F.col(key) == F.col("__gone"), "left_anti"))


def keep_keys(df: DataFrame, kept: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """Semi-join of df with a key set: the filter drops most of df before the exact join."""
    bitmap = key_bitmap(kept, key, bits)
    maybe = with_membership(df, bitmap, F.col(key), "__maybe", bits).where("__maybe").drop("__maybe")
    return maybe.join(kept.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")
