"""Near-duplicate documents: DartMinHash signatures over word shingles, banded joining, exact verification.

Every weighted shingle owns a region of the plane weight x rank. Darts are thrown at the plane as a Poisson process that
depends on the shingle alone, so equal shingles of different documents are hit by equal darts; a document throws only down to the
rank where about K ln K darts have hit it, and keeps the earliest dart of each of K coordinates. Two
signatures agree in a coordinate with the weighted Jaccard similarity of their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, prepare, small, written

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 25
K = 128
"""Coordinates; the first ROWS x BANDS make the bands, all of them the sketch of two bits each."""
STRETCH = 1 << 18
AT_ONCE = 100_000
"""Shingles whose darts are thrown at once (more only for a longer document)."""
CUT = 0.5
"""Pairs whose sketches say less are not verified: seven standard errors below SIMILARITY."""
BUCKET = 500
"""A bucket of more documents is dealt into parts that share one document of it; what that leaves apart is compared exactly, see missed_links."""
BLOCK = 50_000
"""Shingles, about, in a block of a cluster that is examined again; larger clusters are split into pairs of blocks, see block_pairs."""

WANTED_ROWS = 500_000
"""Candidates whose texts are looked up by a broadcast of three numbers each; for more of them texts and numbers are shuffled."""

_WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
_IS_WORD = np.array([bool(_WORD.match(chr(c))) if c < 128 else True for c in range(256)])
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[str]:
    """Lower-case words: runs of anything but ASCII punctuation, white space and control characters."""
    return _WORD.findall((text or "").lower())


_BASE = 0x2D358DCCAA6C78A5
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def _hashes(data: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(_IS_WORD[data].view(np.int8), prepend=0, append=0))
    if not len(edge):
        return np.zeros(0, _U)
    power, inverse = _grown(len(data) + 1)
    running = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=running[1:])
    start, end = edge[::2], edge[1::2]
    return _mix((running[end] - running[start]) * inverse[start] + (end - start).astype(_U) * _ODD)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order: differences of a running polynomial over the bytes, shifted to one place and mixed.

    A long text is hashed in stretches of about STRETCH bytes that end between words.
    """
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= STRETCH:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of WORDS words; a shorter text is one shingle, a wordless one none."""
    h = word_hashes(text)
    span = min(WORDS, len(h))
    if not span:
        return h
    n = len(h) - span + 1
    total = np.zeros(n, _U)
    for k in range(span):
        total = _mix(total + h[k : k + n] + _ODD)
    return np.unique(total)


def signatures(items: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """K coordinates for each set of element hashes (rows x K, 64 bits: rank, then the dart's hash); weights default to 1.

    Element x throws darts at rate ceil(weight) in rank, each with a uniform height; a dart counts if its height is below the weight.
    """
    out = np.full((len(items), K), _U(2**64 - 1), _U)
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    if not len(owner):
        return out
    x = np.concatenate(items)
    w = np.ones(len(x)) if weights is None else np.concatenate(weights).astype(float)
    # one unit of height for each started unit of weight; the last one may be partly covered
    units = np.ceil(w).astype(np.int64)
    level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    cover = np.minimum(1.0, np.repeat(w, units) - level)
    owner, x = np.repeat(owner, units), _mix(np.repeat(x, units) + level.astype(_U) * _ODD)
    mass = np.bincount(owner, cover, len(items))
    reach = np.where(mass > 0, (K * np.log(K) + 2 * K) / np.maximum(mass, 1e-12), 0.0)
    pending = mass > 0
    flat = out.reshape(-1)
    while pending.any():  # a second time only for the few that left a coordinate empty
        live = np.flatnonzero(pending[owner])
        rank, seed, step = np.zeros(len(live)), x[live], 0
        while len(live):
            step += 1
            seed = seed + _ODD
            h = _mix(seed)
            rank = rank - np.log((h >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            near = rank < reach[owner[live]]
            live, rank, seed, h = live[near], rank[near], seed[near], h[near]
            dart = _mix(h ^ _U(0xD6E8FEB86659FD93))
            height = (dart >> _U(40)).astype(np.float64) * 2.0**-24
            hit = height < cover[live]
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (dart[hit] & _U(0xFFFFFFFF))
            np.minimum.at(flat, owner[live[hit]] * K + (_mix(dart[hit] + _ODD) % _U(K)).astype(np.int64), value)
        pending = pending & (out == _U(2**64 - 1)).any(1)
        reach = reach * 2
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    part = sig[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _ODD, (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key + part[:, :, k])
    return key


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate: rows x 4 words."""
    bits = (_mix(sig) & _U(3)).reshape(len(sig), 4, K // 4) << (2 * np.arange(K // 4, dtype=_U))
    return np.bitwise_or.reduce(bits, axis=2)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity that sketches say, chance agreement taken off."""
    d = a ^ b
    same = 1 - np.bitwise_count((d | (d >> _U(1))) & _U(0x5555555555555555)).sum(-1) / K
    return (same - 0.25) / 0.75


def _portions(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, s in enumerate(sets):
        if held and held + len(s) > AT_ONCE:
            yield start, k
            start, held = k, 0
        held += len(s)
    yield start, len(sets)


_SIGNED = "doc_id long, h1 long, h2 long, k1 long, k2 long, bands array<long>, sketch array<long>, bare boolean"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).to_pylist()
        sets = [shingles_of(t) for t in texts]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass"), seed=1) for s, t in zip(sets, texts, strict=True)]
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        sig = np.concatenate([signatures(sets[a:b]) for a, b in _portions(sets)])
        bands, sketch = bands_of(sig).view(np.int64), sketch_of(sig).view(np.int64)
        bare = np.array([not len(s) for s in sets], bool)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1))) for m in (bands, sketch)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(halves[:, 0]), pa.array(halves[:, 1]), *lists, pa.array(bare)], names=["doc_id", "h1", "h2", "k1", "k2", "bands", "sketch", "bare"])


def _spanning(ids: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest by sketch likeness, those of at least CUT: it keeps the groups of any higher similarity."""
    n = len(ids)
    best, by, left = np.full(n, -9.0), np.zeros(n, np.int64), np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        left[at] = False
        like = likeness(s, s[at])
        better = left & (like > best)
        best[better], by[better] = like[better], at
        at = int(np.where(left, best, -99.0).argmax())
        if best[at] >= CUT:
            edges.append((int(ids[at]), int(ids[by[at]])))
    return edges


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may go on in the next batch."""

    def out(keys: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        size = np.diff(np.r_[start, len(keys)])
        two = start[size == 2]
        two = two[likeness(s[two], s[two + 1]) >= CUT]
        edges = list(zip(ids[two].tolist(), ids[two + 1].tolist(), strict=True))
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            edges += _spanning(ids[a : a + n], s[a : a + n])
        u = np.array([min(e) for e in edges], np.int64)
        v = np.array([max(e) for e in edges], np.int64)
        pairs = np.unique(np.stack([u, v], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy() for c in batch.columns], 1)
        held = now if held is None else np.concatenate([held, now])
        last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield out(held[:cut, :2], held[:cut, 2], held[:cut, 3:].view(_U))
            held = held[cut:]
    if held is not None and len(held):
        yield out(held[:, :2], held[:, 2], held[:, 3:].view(_U))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles_of(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "shingles"])


def candidate_links(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (node, bands, sketch): (u, v) of documents whose signatures share a band and look alike, and (u, v) of the pivot and each document of a bucket that was dealt into parts."""
    rows = signed.select("node", F.explode("bands").alias("band"), "sketch")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    sizes = written(sizes, "buckets")
    parts = rows.join(sizes, "band")
    deals = F.ceil(F.col("n") / BUCKET).cast("int")
    part = F.pmod(F.xxhash64("node", "band"), deals)
    # the pivot of a large bucket is in each of its parts
    part = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), deals - 1)).otherwise(F.array(part.cast("int")))
    flat = parts.withColumn("part", F.explode(part)).select("band", F.col("part").cast("long"), "node", *[F.col("sketch")[k].alias(f"s{k}") for k in range(4)])
    dealt = flat.repartition("band", "part").sortWithinPartitions("band", "part", "node")
    crowds = rows.select("node", "band").join(small(sizes.where(F.col("n") > BUCKET)), "band").where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    return dealt.mapInArrow(_link, "u long, v long").distinct(), crowds.distinct()


def alike_classes(sets: list[np.ndarray], classes: np.ndarray, blocks: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of classes that similar sets join, enough of them to connect all that any similar pair connects.

    Two sets are compared if they share one of their rarest shingles, of which each needs to look at so many only that a similar set
    cannot miss all (prefix filter). Where there are two blocks, only pairs across them count.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    reach = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    head = order[(place < np.repeat(reach, size)) & (count[token[order]] > 1)]
    of, what = owner[head], token[head]
    listed = of[np.argsort(what, kind="stable")]
    start = np.r_[0, np.cumsum(np.bincount(what, minlength=len(count)))]
    own = np.r_[0, np.cumsum(np.bincount(of, minlength=len(sets)))]
    across, out = len(np.unique(blocks)) > 1, []
    _, root = np.unique(classes, return_inverse=True)
    held = [m.tolist() for m in np.split(np.argsort(root, kind="stable"), np.cumsum(np.bincount(root))[:-1])]
    for a in range(len(sets)):
        near = [listed[start[t] : start[t + 1]] for t in what[own[a] : own[a + 1]]]
        if not near:
            continue
        # most of a hot group is one class soon, so classes are looked at before the lists are sorted
        others = np.concatenate(near)
        others = others[(others > a) & (root[others] != root[a])]
        others = others[np.minimum(size[others], size[a]) >= similarity * np.maximum(size[others], size[a]) - 1e-9]
        for b in np.unique(others[blocks[others] != blocks[a]] if across else others):
            if root[b] != root[a]:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common >= similarity * float(size[a] + size[b] - common):
                    out.append((int(classes[a]), int(classes[b])))
                    few, many = sorted((root[a], root[b]), key=lambda r: len(held[r]))
                    root[held[few]] = many
                    held[many] += held[few]
    return out


def block_pairs(members: DataFrame) -> DataFrame:
    """(cluster, i, j, block, node, class): the members of each pair of blocks to compare, from (cluster, class, node, n).

    A cluster of up to BLOCK shingles is one block. In a larger one the members of its largest class have blocks of their own,
    which meet those of the others but not each other: what is one class already needs no comparison. So a class
    of very many near copies costs rows in proportion to its size. A cluster of two documents is left out: its one pair is known.
    """
    by_class = members.groupBy("cluster", "class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    sizes = by_class.groupBy("cluster").agg(F.sum("n").alias("all"), F.sum("m").alias("m"), F.max(F.struct("n", "class")).alias("top")).where("m > 2")
    one = F.col("all") <= BLOCK
    few = F.when(one, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.n")) / BLOCK)))
    many = F.when(one, 0).otherwise(F.ceil(F.col("top.n") / BLOCK))
    sizes = sizes.select("cluster", F.when(~one, F.col("top.class")).alias("top"), few.cast("int").alias("few"), many.cast("int").alias("many"))
    own, h = F.coalesce(F.col("class") == F.col("top"), F.lit(False)), F.xxhash64("node")
    placed = members.join(sizes, "cluster").withColumn("block", F.when(own, F.col("few") + F.pmod(h, F.greatest(F.lit(1), "many"))).otherwise(F.pmod(h, F.col("few"))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") + F.when(own, 0).otherwise(F.col("many")) - 1)))
    return placed.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "class")


def missed_links(refused: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(u, v) of classes that belong together though nothing has passed between them yet; None if there can be none.

    A forest follows the sketches, which are estimates, so the edge that it took may be refused where another one would
    have passed; and a bucket that was dealt into parts has a forest for each part only. `refused` holds the refused edges, and the edges from
    the pivot to all others of each dealt bucket. Classes that these connect are clusters; any similar pair lies in one of them, as a forest connects all
    that look alike. A cluster is examined by its sets, exactly, in blocks of bounded size.
    """
    named = groups.select("node", "class")
    edges = refused.join(named.toDF("u", "cu"), "u", "left").join(named.toDF("v", "cv"), "v", "left")
    edges = written(edges.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct(), "set-apart")
    if edges.isEmpty():
        return None
    clusters = written(connected_components(edges).toDF("class", "cluster"), "clusters")
    members = sets.select("node", "n").join(named, "node", "left").select("node", "n", F.coalesce("class", "node").alias("class")).join(clusters, "class")
    members = written(members, "cluster-members")
    dealt = block_pairs(members).join(sets.select("node", "shingles"), "node")

    def examine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        return pd.DataFrame(alike_classes(rows["shingles"].tolist(), rows["class"].to_numpy(), rows["block"].to_numpy(), similarity), columns=["u", "v"], dtype="int64")

    return dealt.groupBy("cluster", "i", "j").applyInPandas(examine, "u long, v long").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes that tell rows of different id or text apart, text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), *_row_key(doc_id, F.col("text")), "text")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, doc_id.isNull(), text, text.isNull()).alias("h1"), F.xxhash64(text, F.lit(7), doc_id).alias("h2")]


def classify(docs: DataFrame, similarity: float = SIMILARITY, chain: bool = True) -> DataFrame:
    """doc_id, h1, h2 (of id and text), label of every row: equal labels are one class. With chain a doc_id in several classes joins them."""
    prepare(docs.sparkSession)
    rows = _keyed(docs)
    signed = written(rows.mapInArrow(_sign, _SIGNED), "signatures")
    named, low = F.col("doc_id").isNotNull(), F.col("low")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2")).alias("first")
    classes = signed.groupBy("k1", "k2").agg(first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("bare").alias("bare")).withColumn("low", F.col("first.doc_id"))
    # a node's number is its smallest id; without one, or where another class has it too, one below zero
    unique = F.row_number().over(Window.partitionBy(F.coalesce(low, "k1"), low.isNull()).orderBy("k1", "k2")) == 1
    node = F.when(low.isNotNull() & unique, low).otherwise(-F.shiftrightunsigned(F.xxhash64("k1", "k2"), 1) - 1)
    classes = written(classes.withColumn("node", node), "classes")
    links, crowds = candidate_links(classes.where("not bare"))
    links, crowds = written(links, "candidates"), written(crowds, "crowds")
    ends = written(links.select(F.col("u").alias("node")).union(links.select("v")).union(crowds.select("u")).union(crowds.select("v")).distinct(), "candidate-ids")
    wanted = small(written(classes.join(ends, "node", "left_semi").select("node", "first.h1", "first.h2"), "wanted-texts"), WANTED_ROWS)
    sets = rows.join(wanted, ["h1", "h2"]).select("node", "text").mapInArrow(_shingle_rows, "node long, n long, shingles array<long>").dropDuplicates(["node"])
    sets = written(sets, "shingles")
    left = links.join(sets.select("node", F.col("shingles").alias("a")), F.col("u") == F.col("node")).drop("node")
    both = left.join(sets.select("node", F.col("shingles").alias("b")), F.col("v") == F.col("node")).drop("node")
    common = F.size(F.array_intersect("a", "b"))
    verdicts = written(both.select("u", "v", (common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)).alias("alike")), "verdicts")
    groups = written(connected_components(verdicts.where("alike").select("u", "v")).withColumnRenamed("component", "class"), "groups")
    more = missed_links(verdicts.where("not alike").select("u", "v").union(crowds), groups, sets, similarity)
    own = written(signed.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).join(groups, "node", "left").select("doc_id", "h1", "h2", F.coalesce("class", "node").alias("class")), "row-classes")
    if chain:
        spread = own.where(named).groupBy("doc_id").agg(F.min("class").alias("u"), F.max("class").alias("top")).where("u <> top")
        chained = own.join(written(spread, "repeated-ids"), "doc_id").where("class <> u").select("u", F.col("class").alias("v")).distinct()
        more = chained if more is None else more.union(chained)
    if more is None:
        return own.withColumnRenamed("class", "label")
    joined = written(connected_components(more).toDF("class", "whole"), "joined-classes")
    return own.join(small(joined), "class", "left").select("doc_id", "h1", "h2", F.coalesce("whole", "class").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept of every document: classes of the graph of similarity 0.8 or more on sets of five-word shingles.

    Texts of the same shingles are one class from the start, so copies are never paired. The class id is its smallest
    doc_id; kept marks that document. Texts shorter than five words are one shingle; wordless texts (null counts as empty)
    match only equal ones. Rows that repeat a doc_id are taken for one document and share a class, all of them kept or not. Rows of null doc_id are
    compared like any other; one joins its class and is never kept in it, unless no row of the class has an id (class_id null, kept). Further columns are
    ignored; an empty table gives no rows.
    """
    rows = classify(docs, similarity)
    # a label of zero or more is the smallest id of its class; the few below may have to be renamed
    names = rows.where("label < 0").groupBy("label").agg(F.min("doc_id").alias("name"), F.lit(True).alias("renamed"))
    rows = rows.join(small(written(names, "class-names")), "label", "left")
    out = rows.select("doc_id", F.when(F.col("renamed"), F.col("name")).otherwise(F.col("label")).alias("class_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id, ids before nulls.

    Classes are of texts, so a doc_id whose rows have different texts loses none of them; rows that are equal in id and text count once. Null texts are
    empty; a class without any doc_id keeps a row too; columns, whatever their names, stay as they are; an empty table gives no rows.
    """
    rows = classify(docs, chain=False)
    kept = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("first")).select(F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    row = row.select("doc", *_row_key(F.col("doc.doc_id").cast("long"), F.col("doc.text")))
    return row.join(written(kept, "kept-rows"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("doc.*")
