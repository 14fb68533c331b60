"""Digests of written artifacts: files are read by tasks, chunk by chunk, and compared as tables."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a leaf of a file's digest.
CHUNK = 1 << 20
LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy")


def digests(spark: SparkSession, folder: str, leave_out: tuple[str, ...] = ("manifest.json",)) -> DataFrame:
    """(path, bytes, digest) of every file below a folder, paths relative to it.

    A digest is that of the digests of a file's chunks, in order. Files of under 2 GB; hidden and empty ones have none.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    leaf = lambda i: F.sha2(F.substring(F.col("content"), i * CHUNK + 1, F.lit(CHUNK)), 256)
    leaves = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / CHUNK) - 1, F.lit(0)).cast("int")), leaf)
    # What stands before the path of a file differs by store ("file:/" and "file:///"), its end doesn't.
    tail = root.split(":", 1)[-1].lstrip("/")
    path = F.expr(f"substring(path, instr(path, '{tail}/') + {len(tail) + 1})")
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2(F.array_join(leaves, ""), 256).alias("digest")).where(~F.col("path").isin(*leave_out))


def compared(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of what differs between two tables of digests: changed, vanished or new."""
    both = kept.select("path", F.col("digest").alias("a")).join(now.select("path", F.col("digest").alias("b")), "path", "full_outer")
    status = F.when(F.col("b").isNull(), "vanished").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def commit(folder: str = ".") -> str | None:
    """The commit that a folder's repository is at, null without one."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    except OSError:
        return None
    return done.stdout.strip() or None


def facts(seed: int, config: dict[str, Any], code: str = ".") -> dict[str, Any]:
    """What else a run depends on: seed, digest of the configuration, commit, versions."""
    versions = {"python": platform.python_version()} | {name: metadata.version(name) for name in LIBRARIES}
    return {"seed": seed, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "commit": commit(code), "versions": versions}
