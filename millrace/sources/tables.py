"""Parquet tables of a folder: scans, temp views, listing, and places that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet scan; filters and columns reach it through the plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sink(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write rows as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that driver and executors share: spark.checkpoint.dir, else the warehouse.

    A machine-local temporary folder is taken only where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None and spark.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
