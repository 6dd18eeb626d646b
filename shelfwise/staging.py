"""Written intermediate tables.

A staged table cuts the lineage of an expensive step, lets several consumers read it without repeating the step and
survives the loss of executors, because it lives in the shared folder that the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT_SETTING = "spark.checkpoint.dir"

_local_root: str | None = None
_bucketed: list[str] = []
_passing: list[list[str]] = []


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's setting, or a scratch folder when running in local mode."""
    root = spark.conf.get(ROOT_SETTING, None) or spark.sparkContext.getConf().get(ROOT_SETTING)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {ROOT_SETTING} to a shared folder: staged tables must be visible to every executor")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def new_stage_path(spark: SparkSession, label: str) -> str:
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    return path


def _own_folder(spark: SparkSession) -> str:
    """The root is shared by all applications of a cluster; each has a folder of its own."""
    return f"{stage_root(spark)}/shelfwise-stages/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_once(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """The named columns for several consumers: a scan with plain columns is left as it is, rows that a join, a grouping or any other shuffle makes are
    written once, so that no consumer makes them anew."""
    narrow = df.select(*[F.col(f"`{c}`") for c in df.columns if c in columns])
    plan = str(narrow._jdf.queryExecution().optimizedPlan().toString()) if hasattr(narrow, "_jdf") else ""
    made = re.search(r"^[\s:+|-]*(Join|Aggregate|Window|Repartition\w*|Rebalance\w*|Sort|Distinct|Generate)\b", plan, re.MULTILINE)
    writable = not any(isinstance(f.dataType, T.NullType) for f in narrow.schema.fields)
    return stage(narrow, label) if made and writable else narrow


def stage_buckets(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` once in buckets of ``key`` and return a scan of it; joins on ``key`` read the rows in place and deal out the other side only.

    There are as many buckets as shuffle partitions, below which Spark would deal them out anew. Buckets cannot be split, so ``key`` should be
    nearly unique."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"stage_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").mode("errorifexists").option("compression", "zstd")
    writer.option("path", new_stage_path(spark, label)).bucketBy(buckets, key).saveAsTable(name)
    _bucketed.append(name)
    return spark.table(name)


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, as the optimizer knows them; rows that lie in no file count nothing."""
    if not hasattr(df, "_jdf"):
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName() == "LogicalRelation")


def settle(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """Stage ``df``, then delete the shuffle files that it needed and the staged tables ``used``, which nothing else may read."""
    staged = stage(df, label)
    discard(staged.sparkSession, *used, wait=True)
    return staged


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end, when nothing may read them any more, with the shuffle files of the work done."""
    _passing.append([])
    try:
        yield
    finally:
        for folder in _passing.pop():
            _delete(spark, folder)
    discard(spark, wait=True)


def stage_result(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stage what ``make`` returns and delete the tables that were staged on the way, which nothing else may read."""
    _passing.append([])
    try:
        result = stage(make(), label)
        kept = _passing[-1].pop()
    finally:
        for folder in _passing.pop():
            _delete(spark, folder)
    if _passing:
        _passing[-1].append(kept)
    discard(spark)
    return result


def discard(spark: SparkSession, *tables: DataFrame, wait: bool = False) -> None:
    """Delete staged tables that nothing reads any more, and the shuffle files of finished work: Spark drops these when the driver's garbage
    is collected, which a driver with a large heap seldom does. With ``wait`` what still holds the last query goes before, which takes up to a second: the
    listeners let go of its end when they get another event, and objects that Python has released reach the driver by and by."""
    drop(spark, *tables)
    gc.collect()
    if wait:
        spark.sql("select 1").collect()
    released = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while wait and released and time.monotonic() < until:
        time.sleep(0.02)
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    own = _own_folder(spark)
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if own.split(":", 1)[-1].lstrip("/") in folder:
                _delete(spark, folder)


def drop_stages(spark: SparkSession) -> None:
    """Delete the staged tables of this application; call it when no result that reads them is needed any more."""
    while _bucketed:
        spark.sql(f"drop table if exists {_bucketed.pop()}")
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
