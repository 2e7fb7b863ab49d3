"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

cos(Wx + b) features approximate a Gaussian kernel over standardised statistics of the whole text. Partitions
sum their part of the normal equations, which are solved once on the driver (COMPONENTS + 1 unknowns, whatever the
corpus). Scores of labelled rows that the fit has not seen are binned and calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, prepare, written

COMPONENTS = 256
RIDGE = 1.0
SEED = 11
BINS = 2000

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,), "stop": b".?!", "comma": b",;:", "bang": b"!", "bar": b"|",
    "mark": b"#$%&*@^~_=+<>\\/{}[]", "quote": b"\"'()`-", "wide": range(128, 256), "control": (*range(9), *range(14, 32), 127),
}
_BYTE_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _BYTE_CLASS[list(_members), _k] = 1
N_STATS = len(_CLASSES) + 12


def statistics_of(text: str) -> list[float]:
    """Statistics of the whole text; all zero for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * N_STATS
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _BYTE_CLASS / len(data)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    kinds = Counter(words)
    line_kinds = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in line_kinds.items()) / max(1, sum(map(len, lines)))
    length = sum(map(len, words))
    return [
        *shares.tolist(), np.log1p(len(data)), np.log1p(n), np.log1p(m), length / n, len(kinds) / n, np.log(len(kinds) + 1) / np.log(n + 1.5), kinds.most_common(1)[0][1] / n if words else 0.0,
        repeated, np.log1p(length / m), max(map(len, words), default=0) ** 0.5, sum(c for w, c in kinds.items() if w.isalpha()) / n, sum(c for w, c in kinds.items() if w.isupper()) / n,
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics_of(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _vectors(rows: DataFrame, work, width: int) -> np.ndarray:
    """Sum over all partitions of work(x, y), a matrix: added up by row before the driver gets one matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch.column(0), N_STATS), batch.column(1).to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width), strict=True):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])

    got = rows.select("x", "y").mapInArrow(partial, "i int, v array<double>").repartition("i").mapInArrow(add, "i int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of sorted x: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATS, COMPONENTS)) / np.sqrt(2 * N_STATS)
        self.b = rng.uniform(0, 2 * np.pi, COMPONENTS)
        self.beta = np.zeros(COMPONENTS + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / COMPONENTS), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 * np.clip(raw, 0, 1), 0, 1)


def fit(train: DataFrame) -> Model:
    """train: x, y (0 or 1), calibrate. Without rows of both classes every score is the share of label 1, or one half."""
    sums = _vectors(train, lambda x, y: np.vstack([np.hstack([np.ones((1, 1)), x.sum(0)[None], np.array([[y.sum()]])]), np.hstack([np.ones((1, 1)), (x**2).sum(0)[None], np.array([[len(y)]])])]), N_STATS + 2)
    n = sums[1, -1] if len(sums) else 0.0
    positive = sums[0, -1] if len(sums) else 0.0
    if not n or positive in (0.0, n):
        model = Model(np.zeros(N_STATS), np.ones(N_STATS))
        rate = positive / n if n else 0.5
        model.knots = (np.array([0.0, 1.0]), np.array([rate, rate]))
        return model
    mean = sums[0, 1:-1] / n
    model = Model(mean, np.sqrt(np.maximum(sums[1, 1:-1] / n - mean**2, 1e-12)) + 1e-6)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    def solve(rows: DataFrame) -> np.ndarray | None:
        a = _vectors(rows, normal, COMPONENTS + 2)
        return np.linalg.solve(a[:, :-1] + RIDGE * np.diag([1.0] * COMPONENTS + [1e-9]), a[:, -1]) if len(a) else None

    beta = solve(train.where("not calibrate"))
    whole = solve(train)
    model.beta = whole if beta is None else beta

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.raw(_matrix(batch.column(0), N_STATS))
            yield pa.RecordBatch.from_arrays([pa.array(np.round((s + 0.5) * BINS / 2).astype(np.int32)), batch.column(1).cast(pa.int32())], names=["bin", "y"])

    counts = train.where("calibrate").select("x", "y").mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()  # at most BINS + 1 rows
    if counts:
        w = np.array([r["n"] for r in counts], float)
        model.knots = pool_adjacent(np.array([r["bin"] for r in counts]) * 2 / BINS - 0.5, np.array([r["s"] for r in counts]) / w, w)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels are joined by doc_id and learned from only where crc32(doc_id) mod 3 is not 1 and quality is 0 or 1; a quarter of
    those, by another hash, calibrates. Scores use the text alone. Null text counts as empty; a null doc_id is scored and
    not learned from; a document labelled repeatedly counts each time; further columns are ignored; empty
    tables give no rows or, without labels, scores of one half.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold_of("doc_id").alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    stats = written(rows.mapInArrow(_stats, "doc_id long, held_out boolean, x array<double>"), "quality-stats")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    train = stats.where("not held_out").join(known, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate"))
    model = fit(written(train, "quality-train"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2), N_STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
