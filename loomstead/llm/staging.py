"""Written tables in the cluster's shared folder: lineage cuts that survive executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot with over 1 / HOT_KEYS of the rows, and MIN_HOT of them.
HOT_KEYS, MIN_HOT = 2000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary one is used;
    a local session has one machine, so driver and executors do share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it a new column name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``left`` with the one row of ``right`` of its keys; ``count`` is how many rows of ``left`` have them.

    ``total`` is the number of those rows. Keys with over 1 / ``HOT_KEYS`` of them (so fewer than ``HOT_KEYS`` keys)
    are joined where the rows are, so a key with a third of all rows never meets in one task. ``left`` is read
    twice and ``right`` is a written table. Rows whose keys are null or unknown are dropped.
    """
    least = max(MIN_HOT, total // HOT_KEYS)
    hot = right.where(F.col(count) > least).drop(count)
    if hot.isEmpty():
        return left.join(right.drop(count), keys)
    there = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(right.where(F.col(count) <= least).drop(count), keys)
    return there.unionByName(rest)


class Masked:
    """A table whose columns other than ``own`` have neutral names for a while, so none can clash."""

    def __init__(self, df: DataFrame, own: tuple[str, ...]):
        self.names = df.columns
        self.inner = [c if c in own else f"_in_{i}" for i, c in enumerate(df.columns)]
        self.df = df.toDF(*self.inner)

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.inner).toDF(*self.names)


class Stage:
    """Tables written under one operator run; superseded ones can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """Write ``df`` once and read it back: one computation, no lineage behind it.

        ``narrow``: ids and links only; written in at most four files a core, because every
        small file costs more than its rows.
        """
        if narrow:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def release(self) -> None:
        """Let Spark delete shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing still to be computed reads."""
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            place.getFileSystem(conf).delete(place, True)
