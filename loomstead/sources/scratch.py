"""Tables written between rounds, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Cuts lineage by writing a table once and reading it back."""

    def __init__(self, spark: SparkSession):
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:  # only a local session has one machine
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        self.root, self.spark, self.count = f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex}", spark, 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all tables of this object; nothing still to be computed may read them."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.root)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
