"""What several operators share: the shared folder, written cuts of lineage, and running totals without one-task windows."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java form of the words that several contracts count.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only where it is unset and there is one machine (tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM has gone; the folder's owner cleans up
            return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cumulate(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str, value: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` (1 if none) over the rows before each row of its keys, in the order (bucket, *order).

    No task holds a whole key: rows are dealt by (keys, bucket), sums of buckets make the offsets. Keys must not be null;
    buckets must be bounded in number, since the windows over their sums hold one row for each (keys, bucket)."""
    d = df.withColumns({"_b": bucket, "_v": F.lit(1).cast("long") if value is None else value.cast("long")})
    sums = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = d.join(offsets.hint("merge"), [*keys, "_b"])
    return joined.withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_b", "_v", "_off")


def hash_digits(spark: SparkSession) -> int:
    """How many hex digits of a hash make buckets for `cumulate` that follow the cluster: 16^2 to 16^4, at least one for each shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 2 if parts <= 1 << 8 else 3 if parts <= 1 << 12 else 4


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 increasing values that deal an integer column evenly into ranges. The driver gets these alone."""
    if parts < 2:
        return []
    found = df.stat.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found or []})


def whole_vector(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; what a list has less than `dim` is 0."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == dim).all():
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def number_list(values: list[int]) -> Column:
    """An array of longs that stands in a plan as one string literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the value, 0 for null: ascending buckets. A value is compared with a bound of
    each run of bounds and then with those of its run, about twice the square root of their number in all."""
    if not bounds:
        return F.lit(0)
    run = max(1, int(len(bounds) ** 0.5))
    heads = number_list(bounds[::run])
    at = F.size(F.filter(heads, lambda b: b <= column))
    inside = F.size(F.filter(F.slice(number_list(bounds), (at - 1) * run + 1, F.lit(run)), lambda b: b <= column))
    return F.when(column.isNull() | (at == 0), 0).otherwise((at - 1) * run + inside)


def range_parts(spark: SparkSession) -> int:
    """So many ranges that each fits a task: four for each shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives a Python worker's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows with about `most` bytes; null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Rows of a key that always go to one task.
HOT_ROWS = 1_000


def join_dealt(big: DataFrame, small: DataFrame, keys: list[str], deal: list[Column], how: str = "inner") -> DataFrame:
    """big joined with small, which has a key once: keys that hold more of big than a sixteenth of a partition's even
    share are dealt, by a hash of `deal`, to as many groups as there are partitions, each with a copy of small's row.

    There are at most 16 such keys for each partition, which bounds the list of them that is broadcast. big is read
    twice. Keys must not be null."""
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, big.count() // (16 * parts))
    used = big.groupBy(*keys).agg(F.count("*").alias("_uses")).filter(F.col("_uses") > least)
    hot = F.broadcast(cut(used.select(*keys, F.lit(1).alias("_hot")), "hot"))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*deal), F.lit(parts))).otherwise(0).cast("int")
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
