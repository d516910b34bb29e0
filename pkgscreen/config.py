"""Limits that a deployment may change; every job takes them as an argument."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    blur: float = 100.0
    brightness_min: float = 50.0
    brightness_max: float = 240.0
    contrast: float = 30.0
    glare: float = 0.15
    skew: float = 0.3
    usable_score: float = 60.0
    readable_lines: int = 2
    readable_confidence: float = 0.90
    review: float = 0.70
    auto_accept: float = 0.90
    legible: float = 0.85
    base_region: float = 0.70
    association_cap: float = 0.65


DEFAULT = Thresholds()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables written between jobs, as ``spark.checkpoint.dir`` names it.

    Only a local master may go without the setting: there driver and executors are
    one process, so a fresh local folder is shared. Elsewhere its absence is an
    error, since parts written to executors' own disks would be lost on reading.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table written to the shared folder; whatever store the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: evaluated once, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that may hold many rows: never sent round, however small its compressed files look."""
    return df.hint("merge")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` for all cores: rows of a file that fewer tasks would read than there are cores are dealt out by key; larger tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key) if df.rdd.getNumPartitions() < cores else df


PART_ROWS = 400_000  # rows of a part: what a task sorts and groups stays in memory, however large the table


def spread(df: DataFrame, key: str, rows: int, name: str = "part") -> DataFrame:
    """Bring ``rows`` rows together by key once, in parts of bounded size that the column ``name`` numbers.

    Groupings that begin with ``name`` need no further exchange. There are never
    fewer parts than ``spark.sql.shuffle.partitions``: the stages that follow are
    bound by regular expressions, not by size.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartitionById(parts, name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        spark.sparkContext.addPyFile(shutil.make_archive(tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/pkgscreen", "zip", root.parent, root.name))
        _SHIPPED.add(app)
