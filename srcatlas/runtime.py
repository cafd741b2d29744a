"""Session helpers: scratch tables in the cluster's shared folder, table reading."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder spark.checkpoint.dir names, or the one the session was given.

    Only a local session, whose tasks see the driver's disk, gets one of its own; on a cluster every machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        master = spark.sparkContext.master or ""
        if not re.match(r"local(\[.*\])?$", master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="srcatlas-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir("file://" + folder)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    A table that a later step no longer needs is dropped with `drop`; the last ones stay as long as
    the application, as results read them, and are removed at its end: local folders when the interpreter exits, others when `Scratch.clean` is called.
    """

    _roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/srcatlas-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        Scratch._roots.append(self.root)
        if self.root.startswith("file:") or "://" not in self.root:
            atexit.register(shutil.rmtree, self.root.removeprefix("file://").removeprefix("file:"), True)

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write df and read it back; returns the new frame and its path."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str | None) -> None:
        _delete(self.spark, *paths)

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Remove all scratch tables made in this application; call it when no result is needed any more."""
        _delete(spark, *cls._roots)
        cls._roots.clear()


def _delete(spark: SparkSession, *paths: str | None) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            target = jvm.org.apache.hadoop.fs.Path(p)
            target.getFileSystem(conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame, least: int = 0) -> DataFrame:
    """Repartition where the input arrives in fewer partitions than there are cores (one small file)."""
    want = max(least, spark.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def ordinals(spark: SparkSession, df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with `ordinal`, from 1, within each key by order. A key of any size is spread: rows are numbered within ranges, and each range starts behind those before it."""
    ranges = df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    rows, _ = Scratch(spark, "ranked").cut(ranges)
    sizes = rows.groupBy(key, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(F.col(key).alias("_key"), F.col("_range").alias("_in"), "_start")
    here = rows.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    both = here.join(starts, here[key].eqNullSafe(starts["_key"]) & (here["_range"] == starts["_in"]))
    return both.withColumn("ordinal", F.col("_row") + F.col("_start")).drop("_range", "_key", "_in", "_start", "_row")


def cores(spark: SparkSession) -> int:
    return max(int(os.environ.get("SRCATLAS_CORES", "0")), spark.sparkContext.defaultParallelism)
