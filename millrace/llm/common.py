"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
"""Rows of an Arrow batch: a batch of long documents still fits a Python worker."""

BROADCAST_ROWS = 100_000
"""Narrow tables of at most so many rows are broadcast, larger ones are joined by a shuffle."""


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse; a temporary one only where they are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and spark.sparkContext.master.startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written narrow table if its row count is within the bound."""
    return F.broadcast(df) if df.count() <= limit else df


def fold_of(doc_id) -> F.Column:
    """True for held-out rows: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(u, v) links of long ids -> (node, component): component is the smallest id that links reach.

    Alternates large-star and small-star steps until the links are stars: no node has two smaller neighbours, and no smaller
    neighbour has one itself. A star's centre may hold a third of all links, so no step groups or joins links in one task: minima are
    aggregated partially, and the one join, of links with minima, has one row for each node on its other side, which
    adaptive execution may broadcast or split. Every round is written to the shared folder, so a lost executor costs one round.
    """
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u")
        nxt = small_star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = written(nxt, "links")
        parents = cur.select("u").distinct().count()
        if parents == cur.count() and cur.join(cur.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
