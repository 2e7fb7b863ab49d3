"""Relational operators as thin compositions of DataFrame operations; Catalyst picks the physical ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINS = {"inner": "inner", "left": "left", "right": "right", "semi": "left_semi", "anti": "left_anti"}


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """WHERE: rows for which the predicate is true, not false or NULL."""
    return df.where(predicate)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Named output columns."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Equi and theta joins; several equalities in `on` are all used as keys."""
    return left.join(right, on, JOINS[how])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def aggregate(df: DataFrame, by: Sequence[str] = (), having: Column | None = None, **measures: Column) -> DataFrame:
    """GROUP BY with named measures, one row without keys, distinct keys without measures; then HAVING."""
    named = [m.alias(n) for n, m in measures.items()]
    out = df.groupBy(*by).agg(*named) if named else df.select(*by).distinct()
    return out if having is None else out.where(having)


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column], **functions: Column) -> DataFrame:
    """Ranking functions over one window; row_number needs a total order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({n: f.over(w).cast("bigint") for n, f in functions.items()})


def numbered(df: DataFrame, order: Sequence[Column], name: str, path: str) -> DataFrame:
    """row_number() over the whole table without one task for all rows: rows are sorted by ranges, written below path, and numbered from their range's start.

    The driver gets one count for each range. Numbers agree with the window's where the order is total.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    rows = spark.read.parquet(path)
    starts, before = [], 0
    for part, count in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        starts.append((part, before))
        before += count
    at = spark.createDataFrame(starts, "_part int, _start bigint")
    return rows.join(F.broadcast(at), "_part").select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(name))


def ordered(df: DataFrame, **keys: str) -> DataFrame:
    """ORDER BY name="asc"|"desc": NULLs last ascending, first descending."""
    return df.orderBy(*[F.col(k).asc_nulls_last() if d == "asc" else F.col(k).desc_nulls_first() for k, d in keys.items()])


def top(df: DataFrame, n: int, offset: int = 0, **keys: str) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET."""
    out = ordered(df, **keys) if keys else df
    return (out.offset(offset) if offset else out).limit(n)


def combine(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """Set operations; those on all keep counts, the others give sets."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"set operation on {len(left.columns)} and {len(right.columns)} columns")
    return {
        "union all": lambda: left.unionAll(right),
        "union": lambda: left.union(right).distinct(),
        "except": lambda: left.subtract(right),
        "except all": lambda: left.exceptAll(right),
        "intersect": lambda: left.intersect(right),
        "intersect all": lambda: left.intersectAll(right),
    }[kind]()
