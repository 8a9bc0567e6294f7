"""Stashing of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_scratch: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset (one machine), a temporary folder that
    is set for the session. On a cluster it has to be set."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="meshweave-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def stash(df: DataFrame) -> DataFrame:
    """Writes df and reads it back: an iteration's lineage ends here, and lost executors
    lose none of it. The files go when the Python process or the block of scratch() ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *values: Column) -> tuple[DataFrame, dict]:
    """stash(df), and aggregates of its rows that are taken while it is written: a round
    and the test of its end are one job."""
    seen = Observation()
    out = stash(df.observe(seen, *values))
    return out, seen.get


def bucketed(df: DataFrame, key: str, *values: Column) -> tuple[DataFrame, dict]:
    """As observed(), stored in as many buckets of key as a shuffle has partitions: joins
    on key then find both sides in place."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, seen = f"meshweave_{uuid.uuid4().hex}", Observation()
    path = f"{shared_dir(spark)}/{name}"
    dealt = df.repartition(n, key)
    dealt = dealt.observe(seen, *values) if values else dealt
    dealt.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    _kept(spark, path)
    return spark.table(name), seen.get if values else {}


def _kept(spark: SparkSession, path: str) -> None:
    if _scratch:
        _scratch[-1].append((spark, path))
    else:
        atexit.register(remove, spark, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stashed inside the block goes at its end, so that blocks bound what lies on
    disk. Gives a stash() whose files stay."""
    inside: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        _scratch.remove(inside)
        try:
            return stash(df)
        finally:
            _scratch.append(inside)

    _scratch.append(inside)
    try:
        yield keep
    finally:
        _scratch.remove(inside)
        for spark, path in inside:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the shared folder belongs to the cluster
        return
