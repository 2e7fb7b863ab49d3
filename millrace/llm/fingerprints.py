"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes (a window of 16 bytes) marks boundaries; they are normalised: up to
NORMAL bytes a strict test counts, after that a loose one, between MIN and MAX bytes. A fingerprint is the
set of chunk digests, each weighted by the bytes it covers; likeness is the weight of a text's chunks that
the other text holds too, over the text's own weight (containment). Boundaries depend on nearby bytes
only, so chunks behind an insertion are found again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

MIN, NORMAL, MAX = 24, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5
STRETCH = 1 << 18


def _gear_table() -> np.ndarray:
    """A random word for every byte by splitmix64; 0xFF never occurs in UTF-8 and stands for padding."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    table = ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    table[0xFF] = 0
    return table


GEAR = _gear_table()


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks, the last one len(data); none for no bytes."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    loose, strict = [], []
    for at in range(0, n, STRETCH):
        before = min(at, 15)  # a hash depends on its own and the 15 bytes before it
        h = GEAR[raw[at - before : at + STRETCH]]
        for step in (1, 2, 4, 8):
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
        h = h[before:]
        ends = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
        loose += (ends + (at + 1)).tolist()
        strict += (ends[h[ends] < np.uint32(1 << (32 - STRICT_BITS))] + (at + 1)).tolist()
    cuts, start, i, j = [], 0, 0, 0
    while n - start > MIN:
        middle = start + NORMAL
        i = bisect_left(strict, start + MIN, i)
        if i < len(strict) and strict[i] < middle:
            cut = strict[i]
        else:
            j = bisect_left(loose, middle, j)
            cut = min(loose[j] if j < len(loose) else start + MAX, start + MAX)
        if cut >= n:
            break
        cuts.append(cut)
        start = cut
    cuts.append(n)
    return cuts


def chunk_weights(text: str) -> dict[int, int]:
    """Digest of every chunk -> bytes that chunks with it cover."""
    data = text.encode("utf-8", "surrogatepass")
    weights: dict[int, int] = {}
    start = 0
    for end in boundaries(data):
        digest = xxhash.xxh3_64_intdigest(data[start:end])
        weights[digest] = weights.get(digest, 0) + end - start
        start = end
    return weights


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's weight that b holds; two empty texts are alike."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / total


def as_text(weights: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{w}" for d, w in sorted(weights.items())])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and order; a part ends with its neighbour's first document, which is only looked at."""
    held = None
    for batch in batches:
        rows = []
        for part, doc_id, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = chunk_weights(text)
            if held is not None and held[0] == part:
                _, before_id, before, weights = held
                changed = edited(before, text)
                other = chunk_weights(changed)
                rows.append((before_id, len(before), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(weights), as_text(other), containment(weights, other), containment(weights, own)))
            held = None if tail else (part, doc_id, text, own)
        if rows:
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


MOST_PARTS = 100_000
PART_SAMPLE = 20
"""Rows, for each part, whose ids the driver gets to lay out the ranges."""


def ranges_of(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ranges of ids that hold about equal shares of a sorted sample, and in how many parts each is dealt: one id with the rows of several parts has a range of its own."""
    if not len(ids):
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    cuts, times = np.unique(ids[np.arange(1, parts) * len(ids) // parts], return_counts=True)
    deals = {int(c): int(n) for c, n in zip(cuts, times, strict=True)}
    for c, n in zip(cuts.tolist(), times.tolist(), strict=True):
        if n > 1 and c < 2**63 - 1:
            deals.setdefault(c + 1, 1)
    starts = np.array(sorted(deals), np.int64)
    return starts, np.array([1, *(deals[int(c)] for c in starts)], np.int64)


def fingerprint_documents(docs: DataFrame, rows_per_part: int = 4000) -> DataFrame:
    """Fingerprint each document, its half-edited text, and compare it with the next document.

    docs needs doc_id and text; other columns are ignored. Null text counts as empty; null doc_id comes
    last; rows of equal doc_id follow each other by a hash of the text, then by the text; the last row's next is the first. An empty
    table gives no rows.

    Documents are dealt once, by ranges of doc_id from a bounded sample of ids; an id (or null) with very many rows is
    dealt further by the texts' hashes. The neighbour of each part's last document is found from ids and hashes alone and appended, so no part waits for
    another.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    total = rows.count()
    parts = max(1, min(MOST_PARTS, total // rows_per_part))
    starts, deals = np.zeros(0, np.int64), np.ones(1, np.int64)
    if parts > 1:
        share = int(min(1.0, PART_SAMPLE * parts / total) * 1_000_000) + 1
        drawn = rows.where(F.pmod(F.xxhash64("ord", "h"), F.lit(1_000_000)) < share).select("ord").toPandas()  # about PART_SAMPLE rows a part
        starts, deals = ranges_of(np.sort(drawn["ord"].to_numpy(np.int64)), parts)
    offsets = np.cumsum(deals) - deals

    @F.pandas_udf("int")
    def part_of(ids, hashes):
        at = np.searchsorted(starts, ids.to_numpy(np.int64), side="right")
        place = np.minimum((hashes.to_numpy(np.float64) / 2**64 + 0.5) * deals[at], deals[at] - 1).astype(np.int64)
        return ids.__class__((offsets[at] + place).astype(np.int32))

    placed = rows.withColumn("part", part_of("ord", "h") if parts > 1 else F.lit(0))
    firsts = placed.groupBy("part").agg(F.min(F.struct("ord", "h")).alias("first")).collect()  # at most `parts` rows of three numbers
    order = sorted((r["part"], r["first"]["ord"], r["first"]["h"]) for r in firsts)
    follow = [(order[k - 1][0], o, h) for k, (_, o, h) in enumerate(order)]
    heads = spark.createDataFrame(follow, "part int, ord long, h long")
    first_text = rows.join(F.broadcast(heads), ["ord", "h"]).groupBy("part", "ord", "h").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    both = placed.select("part", "doc_id", "text", F.lit(False).alias("tail"), "ord", "h").union(first_text.select("part", "doc_id", "text", F.lit(True), "ord", "h"))
    dealt = both.repartition("part").sortWithinPartitions("part", "tail", "ord", "h", "text")
    return dealt.select("part", "doc_id", "text", "tail").mapInArrow(_compare, _OUT)
