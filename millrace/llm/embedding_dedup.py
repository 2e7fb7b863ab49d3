"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative a group.

Vectors of one length are split into cells of about CELL_ROWS vectors, and cells that are still large once more. A vector lives
in its nearest cell, its home, and visits those cells numbered lower than its home whose centroid is less than MARGIN worse by cosine. A pair with cosine >= 0.95
is compared once, in the lower one of its two homes: the other vector visits that with all but vanishing probability. Visitors are not compared
with each other, so rows grow with the number of visits (about two a vector) and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, prepare, small, written

THRESHOLD = 0.95
MARGIN = 0.18
SAMPLE = 20_000
"""The centroids of a cell's parts are fitted on about so many of its vectors; every vector is assigned."""
CELL_ROWS = 4000
PARTS = 256
"""A cell is split into at most so many parts."""
LEVELS = 2
BLOCK = 12_000
"""Vectors, homes and visits together, that one task compares with each other; a larger cell becomes pairs of blocks."""
BROADCAST_BYTES = 64 << 20
"""Centroids of one level are broadcast up to so many bytes, more of them are joined to the rows."""


def fit_cells(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means; a cell that runs empty keeps its centroid."""
    pick = np.random.default_rng(seed).choice(len(vectors), size=k, replace=False)
    centroids = vectors[np.sort(pick)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return centroids


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one cell's parts, from the sample of it; none where a split would make most vectors visit most parts."""
    pdf = pdf.sort_values("rid")
    vectors = np.array(pdf["v"].tolist(), dtype=np.float64)
    k = min(int(pdf["parts"].iloc[0]), len(vectors))
    centroids = fit_cells(vectors, k)
    like = vectors @ centroids.T
    if k > 1 and (like >= like.max(1)[:, None] - MARGIN).mean() > 0.5:
        centroids = centroids[:0]
    return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "centroids": [centroids.reshape(-1)]})


_ROWS = "rid long, copies long, v array<double>, leaf string, home boolean"


def _assign(known: dict[str, np.ndarray] | None):
    """Rows moved from their cell to its parts: a home row to its nearest part and those of lower number within MARGIN, a visitor to all within MARGIN."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, homes = batch.column(3).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
            vectors, joined = batch.column(2), batch.column(5)
            take, parts, at_home = [], [], []
            for leaf in dict.fromkeys(leaves):
                own = np.array([k for k, x in enumerate(leaves) if x == leaf])
                flat = known.get(leaf) if known is not None else joined[int(own[0])].values
                if flat is None or not len(flat):
                    take.append(own)
                    parts += [leaf] * len(own)
                    at_home.append(homes[own])
                    continue
                v = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                like = v @ np.asarray(flat, dtype=np.float64).reshape(-1, v.shape[1]).T
                nearest = like.argmax(1)
                number = np.arange(like.shape[1])[None]
                near = like >= like.max(1)[:, None] - MARGIN
                near &= ~homes[own][:, None] | (number <= nearest[:, None])
                i, j = np.nonzero(near)
                take.append(own[i])
                parts += [f"{leaf}/{c}" for c in j.tolist()]
                at_home.append(homes[own[i]] & (j == nearest[i]))
            if take:
                order = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(order) for k in range(3)), pa.array(parts, pa.string()), pa.array(np.concatenate(at_home))], names=["rid", "copies", "v", "leaf", "home"])

    return work


def split_cells(rows: DataFrame, level: int) -> DataFrame:
    """One more level of cells for those that have over twice CELL_ROWS vectors at home; centroids come from a bounded sample of each."""
    spark = rows.sparkSession
    sizes = rows.where("home").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CELL_ROWS)
    sizes = written(sizes, "large-cells")
    if sizes.isEmpty():
        return rows
    plan = sizes.select("leaf", F.least(F.lit(PARTS), F.ceil(F.col("n") / CELL_ROWS)).cast("int").alias("parts"), (F.lit(SAMPLE * 1e6) / F.col("n")).alias("share"))
    drawn = rows.where("home").join(small(plan), "leaf").where(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(1_000_000)) <= F.col("share"))
    fitted = written(drawn.select("leaf", "rid", "v", "parts").groupBy("leaf").applyInPandas(_fit, "leaf string, centroids array<double>"), "centroids")
    known = None
    joined = rows.withColumn("centroids", F.lit(None).cast("array<double>"))
    if (fitted.agg(F.sum(F.size("centroids"))).first()[0] or 0) * 8 <= BROADCAST_BYTES:
        known = {r["leaf"]: np.array(r["centroids"]) for r in fitted.collect()}  # BROADCAST_BYTES at most
    else:
        joined = rows.join(fitted, "leaf", "left")
    moved = joined.select("rid", "copies", "v", "leaf", "home", "centroids").mapInArrow(_assign(known), _ROWS)
    return written(moved, "cells")


def _hits(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(a), 512):
        yield at, a[at : at + 512] @ b.T >= threshold


def _block(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links and the smallest reached id of each vector, from the pairs of two blocks (or within one) of which one at least is at home."""
        pdf = pdf.sort_values("rid", kind="stable")
        rid, copies = pdf["rid"].to_numpy(), pdf["copies"].to_numpy().astype(np.float64)
        side, home = pdf["other"].to_numpy(), pdf["home"].to_numpy()
        v = np.array(pdf["v"].tolist(), dtype=np.float64)
        links, label = np.zeros(len(rid)), np.arange(len(rid))
        pick = np.flatnonzero
        if side.any():
            jobs = [(pick(~side & home), pick(side), False), (pick(~side & ~home), pick(side & home), False)]
        else:
            jobs = [(pick(home), pick(home), True), (pick(home), pick(~home), False)]
        for one, two, same in jobs:
            if not len(one) or not len(two):
                continue
            right = v[two]
            for at, hit in _hits(v[one], right, threshold):
                if same:
                    hit &= np.arange(len(two))[None, :] > (at + np.arange(len(hit)))[:, None]
                rows = pick(hit.any(1))
                if not len(rows):
                    continue
                own, hit = one[at + rows], hit[rows]
                links[own] += hit @ copies[two]
                links[two] += copies[own] @ hit
                for r, row in zip(own.tolist(), hit, strict=True):
                    reached = label[two[row]]
                    if label[r] != reached[0] or (reached != reached[0]).any():
                        all_ = np.unique(np.append(reached, label[r]))
                        label[np.isin(label, all_)] = all_[0]
        touched = pick(links)
        return pd.DataFrame({"rid": rid[touched], "links": np.rint(links[touched]).astype(np.int64), "low": rid[label[touched]]})

    return compare


def dedup_embeddings(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Equal vectors are compared once, as one with a count; each of them links with
    the others, also where vec_id repeats. A row of null vec_id counts as a link of others but has a null
    component and kept = true. Further columns are ignored; an empty table gives no rows.
    """
    prepare(rows.sparkSession)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    base = base.withColumn("e", F.when(fine, F.col("e")))
    key = F.sha2(F.concat_ws(",", F.transform("e", lambda x: x.cast("string"))), 256)
    keyed = written(base.select("vec_id", F.when(F.col("e").isNotNull(), key).alias("key"), "e"), "vectors")
    distinct = keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low_id"), F.first("e").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    big = F.array_max(F.transform("e", F.abs))
    distinct = distinct.withColumn("e", F.transform("e", lambda x: x / big)).select("key", "copies", "low_id", F.transform("e", lambda x: x / norm).alias("v"), F.size("e").alias("dim"))
    # a number for each distinct vector: its smallest id; without one, or where another vector has it too, one below zero
    first = F.row_number().over(Window.partitionBy(F.coalesce("low_id", F.xxhash64("key")), F.col("low_id").isNull()).orderBy("key")) == 1
    rid = F.when(F.col("low_id").isNotNull() & first, F.col("low_id")).otherwise(-F.shiftrightunsigned(F.xxhash64("key"), 1) - 1)
    distinct = written(distinct.withColumn("rid", rid), "unit-vectors")
    placed = distinct.select("rid", F.col("copies").cast("long").alias("copies"), "v", F.col("dim").cast("string").alias("leaf"), F.lit(True).alias("home"))
    for level in range(LEVELS):
        placed = split_cells(placed, level)
    sizes = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    blocks = placed.join(small(written(sizes, "cell-sizes")), "leaf").withColumn("b", F.pmod(F.xxhash64("rid", "copies"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    tasks = blocks.withColumn("t", F.explode(pairs)).select("leaf", "t.i", "t.j", (F.col("b") != F.col("t.i")).alias("other"), "home", "rid", "copies", "v")
    found = written(tasks.groupBy("leaf", "i", "j").applyInPandas(_block(threshold), "rid long, links long, low long"), "vector-links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rid").alias("u"), F.col("low").alias("v")))
    classes = distinct.join(links, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid", "left")
    named = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("group"), "low_id")
    # a group's name is its smallest id; groups made of nameless vectors alone have none
    names = named.groupBy("group").agg(F.min("low_id").alias("component_id"))
    named = named.join(names, "group").select("key", "n_links", "component_id")
    out = keyed.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
