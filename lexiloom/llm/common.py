"""Shared plumbing: table access, lineage cuts in the cluster's shared folder, ordered prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, after this package has once been sent to the executors of df's session."""
    sc = df.sparkSession.sparkContext

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    if getattr(sc, "_lexiloom_sent", None) is None:
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        at = os.path.realpath(tempfile.mkdtemp(prefix="lexiloom-code-"))
        sc.addPyFile(shutil.make_archive(f"{at}/lexiloom_code", "zip", os.path.dirname(here), os.path.basename(here)))
        sc._lexiloom_sent = True
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Gives freed memory back to the system: workers live on after a task, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of `key`, which follow one another, as one table."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.column(rb.schema.get_field_index(key))
        cuts = [0, *(pc.indices_nonzero(pc.not_equal(k[1:], k[:-1])).to_numpy() + 1).tolist(), rb.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[a].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(rb.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set: the warehouse, which executors share, or in
    local mode a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lexiloom"
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lexiloom-"))
    return f"file://{_OWN[0]}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: no lineage is left to recompute, and lost
    executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexiloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by cut() that nothing needs any more."""
    path = getattr(df, "_lexiloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def few_of_each(rows: DataFrame, by: str, key: str, per: int) -> DataFrame:
    """Of the rows of each value of `by` the `per` whose hashed `key` is smallest. A hash far above those is left out
    before values are ranked, by counts of the values (there should be few), so that no task gets all rows of a value."""
    spark, low = rows.sparkSession, -(1 << 63)
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()
    bound = [(r[by], min((1 << 63) - 1, low + (1 << 64) * 4 * per // r["n"])) for r in counts if r[by] is not None]
    bounds = spark.createDataFrame(bound, f"{by} {rows.schema[by].dataType.simpleString()}, _bound long")
    some = rows.withColumn("_h", F.xxhash64(key)).join(F.broadcast(bounds), by).where(F.col("_h") <= F.col("_bound"))
    w = Window.partitionBy(by).orderBy("_h", key)
    return some.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= per).select(*rows.columns)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """df range-partitioned by `order` and written with its partition number in `_pid`. A hot leading
    key is split as long as the later columns of `order` tell its rows apart."""
    n = width(df.sparkSession)
    return cut(df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()), tag)


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, Column], tag: str) -> DataFrame:
    """Inclusive running sums of `values` over all rows in `order`. Only one sum per partition reaches
    the driver, so the size of any key's group doesn't matter."""
    spark = df.sparkSession
    p = ranged(df.withColumns({f"_v_{k}": v for k, v in values.items()}), order, tag)
    sums = p.groupBy("_pid").agg(*[F.sum(f"_v_{k}").alias(k) for k in values]).collect()
    run, rows = dict.fromkeys(values, 0), []
    for r in sorted(sums, key=lambda r: r["_pid"]):
        rows.append((r["_pid"], *[run[k] for k in values]))
        run = {k: run[k] + r[k] for k in values}
    schema = "_pid int, " + ", ".join(f"_o_{k} long" for k in values)
    offsets = spark.createDataFrame(rows, schema)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = p.join(F.broadcast(offsets), "_pid")
    return out.select(
        *df.columns, *[(F.sum(f"_v_{k}").over(w) + F.col(f"_o_{k}")).alias(k) for k in values]
    )
