"""Packing documents into token windows that keep the sources' proportions.

Deficit round-robin: in round k each source's queue may have sent floor((k + 1) x quantum) tokens in all, quantum being its
exact share of one window, so what a round could not send stays in its favour, across windows and partitions alike. A
queue is cut where its credit ends. The position of any token in the packed stream follows from the sources' totals
alone; no partition waits for another, and nothing but one row for each source and partition is added up. That takes the totals of all
sources in one place; where sources are many, the pieces are sorted by round and source instead, and their lengths added up: the same stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import prepare, small, written

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
MAX_QUEUES = 256
"""With more sources than this, positions come from a sort of the pieces and not from a list of all sources' totals."""
FLUSH = 20_000
"""Pieces that a Python worker holds before it passes them on."""
CACHE_WORDS = 200_000
"""Words in each of two generations that a Python worker remembers, over all of its tasks."""

# How the vocabulary's file parts words, for the Latin letters and numbers that _PLAIN admits, in lower case.
_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ſ]*+")
_PIECES = re.compile(r"[a-zªµºß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")

# Byte-level vocabularies write a byte as its own Latin-1 character if that is printable, else as one from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTER = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder(dict):
    """Ids of whole texts, as the tokenizers library gives them, by way of a bounded memory of words.

    The vocabulary lower-cases, then encodes each word by itself, so a text's ids are its words' ids. A text with characters beyond
    Latin, where normalisation could join or change neighbours, goes to the library as a whole, and so does one with a special token's name.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.older: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:  # what is not asked for again before the next turn is forgotten
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            written = word.encode().decode("latin-1").translate(_BYTE_CHARACTER)
            ids = np.array([t.id for t in self.whole.model.tokenize(written)], self.kind).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text and END_ID behind them."""
        text = text or ""
        low = text.lower()
        plain = _PLAIN.fullmatch(text) and not any(name in low for name in self.special)
        data = b"".join(map(self.__getitem__, _PIECES.findall(low))) if plain else self._ids(text)
        return np.append(np.frombuffer(data, self.kind), self.kind.type(END_ID))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker, so that its later tasks know the words of the earlier ones."""
    return Encoder(path)


_TOKENS = "doc_id long, queue string, part long, local long, n long, ids binary"


def _tokenize(path: str | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or default_tokenizer())
        part = TaskContext.get().partitionId()
        sent: dict[str | None, int] = {}
        for batch in batches:
            local, sizes, data = [], [], []
            for queue, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = encoder.encode(text)
                before = sent.get(queue, 0)
                sent[queue] = before + len(ids)
                local.append(before)
                sizes.append(len(ids))
                data.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(local), pa.int64()), pa.array(local, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "queue", "part", "local", "n", "ids"])

    return work


class Credit(NamedTuple):
    """A queue of `total` tokens that may have sent floor(k x num / den) before its k-th round from round `first` on."""

    total: int
    num: int
    den: int
    first: int = 0

    def sent(self, k: int) -> int:
        """Tokens that the queue has sent before round k."""
        return min(self.total, max(0, k - self.first) * self.num // self.den)

    def round_of(self, x: int) -> int:
        """The round in which the queue sends its token x."""
        return self.first - (-(x + 1) * self.den // self.num) - 1

    @property
    def last(self) -> int:
        """The first round in which nothing is left."""
        return self.round_of(self.total - 1) + 1 if self.total else self.first


def credits_of(totals: dict[str | None, int], weights: dict[str | None, float] | None, window: int, unweighted: int | None = None) -> tuple[dict[str | None, Credit], int]:
    """A credit for each queue, and the round from which queues without weight send, in proportion to their totals.

    unweighted is the sum of the totals of all queues without weight, where totals does not name them all.
    """
    shares = {q: Fraction(weights.get(q, 0)) if weights else Fraction(t) for q, t in totals.items()}
    if any(w < 0 for w in shares.values()):
        raise ValueError("a weight is below zero")
    whole = sum(shares.values())
    out = {}
    for q, t in totals.items():
        if shares[q]:
            quantum = shares[q] / whole * window
            out[q] = Credit(t, quantum.numerator, quantum.denominator)
    first = max((c.last for c in out.values()), default=0)
    rest = unweighted if unweighted is not None else sum(t for q, t in totals.items() if not shares[q])
    return out | {q: Credit(t, t * window, rest, first) for q, t in totals.items() if not shares[q] and t}, first


def pieces(credit: Credit, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, round) of a stretch of a queue, cut where its credit of a round ends; each in constant time, whatever the share."""
    total, num, den, first = credit
    while start < end:
        k = ((start + 1) * den - 1) // num  # the round of token start: (k + 1) x num >= (start + 1) x den
        stop = min(end, total, (k + 1) * num // den)
        yield start, stop, first + k
        start = stop


def bounds(total: int, window: int, position: int) -> tuple[int, int, int]:
    """Sequence that holds a position of a stream of total tokens: its number, start and end. What is left at the end of the stream goes to
    sequences of falling powers of two, which need no padding."""
    n, at = divmod(position, window)
    full, rest = divmod(total, window)
    if n < full:
        return n, n * window, (n + 1) * window
    number, start, size = full, full * window, window >> 1
    while True:
        if rest & size:
            if position < start + size:
                return number, start, start + size
            number, start = number + 1, start + size
        size >>= 1


class Rounds:
    """Where the deficit round-robin puts each token of each queue, in exact integers."""

    def __init__(self, credits: list[Credit], window: int = WINDOW) -> None:
        self.credits, self.window, self.total = credits, window, sum(c.total for c in credits)
        # sums of 64 bits suffice unless a corpus is huge
        self.kind = np.int64 if max((c.last * c.num for c in credits), default=0) < 1 << 62 and max((c.den for c in credits), default=0) < 1 << 62 else object
        column = lambda f: np.array([getattr(c, f) for c in credits], self.kind)
        self.totals, self.num, self.den, self.first = (column(f) for f in ("total", "num", "den", "first"))

    def sent(self, k: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before round k: rounds x queues."""
        k = np.minimum(np.asarray(k).astype(self.kind)[:, None], np.array([c.last for c in self.credits], self.kind))
        return np.minimum(self.totals, np.maximum(0, k - self.first) * self.num // self.den)


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(order: dict[str | None, int], rounds: Rounds, width: int, with_ids: bool):
    kind = np.dtype(f"<u{width}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts: list[tuple[int, int, int, int]] = []
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for r, (_, queue, begin, n, _) in enumerate(rows):
                s = order[queue]
                cuts += [(r, a, b, k) for a, b, k in pieces(rounds.credits[s], begin, begin + n)]
            if not cuts:
                continue
            turns = np.array([c[3] for c in cuts], rounds.kind)
            distinct, at = np.unique(turns, return_inverse=True)
            before, after = rounds.sent(distinct), rounds.sent(distinct + 1)
            # all of the earlier rounds, then this round's queues in order
            lead = before.sum(1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
            out = []
            for (r, a, b, _), t in zip(cuts, at.tolist(), strict=True):
                doc_id, queue, begin, n, ids = rows[r]
                s = order[queue]
                position = int(lead[t, s]) + a - int(before[t, s])
                out += _laid(doc_id, n, a - begin, np.frombuffer(ids, kind, b - a, (a - begin) * width), position, rounds.total, rounds.window, with_ids)
            yield _packed(out, with_ids)

    return work


def _laid(doc_id: int | None, n: int, at: int, ids: np.ndarray, position: int, total: int, window: int, with_ids: bool) -> list[tuple]:
    """Rows of a piece of a document that begins at its token at, cut where sequences end."""
    out, done = [], 0
    while done < len(ids):
        number, start, end = bounds(total, window, position)
        length = min(len(ids) - done, end - position)
        part = ids[done : done + length].astype("<u4")
        out.append((doc_id, at + done, length, zlib.crc32(part), n, number, position - start, *([part.tobytes()] if with_ids else [])))
        done, position = done + length, position + length
    return out


def _packed(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [*(f.split(" ")[0] for f in _OUT.split(", ")), *(["ids"] if with_ids else [])]
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


_PIECE = "doc_id long, doc_tokens long, start long, ids binary, round long, queue string, begin long"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]


def _cut(known: dict[str | None, Credit], first: int, rest: int, window: int, width: int):
    """Pieces by credits: those of the queues with given weights are known, the others follow from their totals."""
    names = [f.split(" ")[0] for f in _PIECE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], names=names)
        for batch in batches:
            for doc_id, queue, begin, n, ids, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, k in pieces(known.get(queue) or Credit(total, total * window, rest, first), begin, begin + n):
                    out.append((doc_id, n, a - begin, ids[(a - begin) * width : (b - begin) * width], k, queue, a))
                    if len(out) >= FLUSH:
                        yield flush()
                        out.clear()
        if out:
            yield flush()

    return work


def _run(width: int):
    """Tokens before each piece in its partition of the sorted pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.array([len(x) // width for x in batch.column(3).to_pylist()], np.int64)
            before = sent + np.cumsum(lengths) - lengths
            sent += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(lengths), part, np.int64)), pa.array(before), pa.array(lengths)], names=["doc_id", "doc_tokens", "start", "ids", "part", "before", "length"])

    return work


def _lay(ahead: dict[int, int], total: int, window: int, width: int, with_ids: bool):
    kind = np.dtype(f"<u{width}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, at, ids, part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += _laid(doc_id, n, at, np.frombuffer(ids, kind), ahead[part] + before, total, window, with_ids)
            if out:
                yield _packed(out, with_ids)

    return work


def _pack_sorted(tokens: DataFrame, sums: DataFrame, weights: dict[str | None, float] | None, window: int, width: int, with_ids: bool) -> DataFrame:
    """The stream of _place for any number of sources: pieces in order of round, source and place in its queue, their lengths added up."""
    spark = tokens.sparkSession
    total = sums.agg(F.sum("size")).first()[0]
    whole = Window.partitionBy("queue")
    known = sums.select(F.col("queue").alias("q"), F.col("part").alias("p"), (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("ahead"), F.sum("size").over(whole).alias("total"))
    given, rest = {}, total
    if weights:  # totals of the caller's names at most
        names = spark.createDataFrame([(q,) for q, w in weights.items() if w], "name string")
        own = sums.join(F.broadcast(names), F.expr("queue <=> name")).groupBy("queue").agg(F.sum("size").alias("size")).collect()
        given = {r["queue"]: r["size"] for r in own}
        rest = total - sum(given.values())
    credits, first = credits_of(given, weights, window, rest) if given else ({}, 0)
    known = written(known, "queue-starts")
    placed = tokens.join(small(known), F.expr("queue <=> q and part = p")).select("doc_id", "queue", (F.col("ahead") + F.col("local")).alias("begin"), "n", "ids", "total")
    cut = written(placed.mapInArrow(_cut(credits, first, rest, window, width), _PIECE), "pieces")  # sampled for its ranges, then sorted
    runs = cut.orderBy("round", F.col("queue").isNull(), "queue", "begin").select("doc_id", "doc_tokens", "start", "ids")
    runs = written(runs.mapInArrow(_run(width), "doc_id long, doc_tokens long, start long, ids binary, part long, before long, length long"), "piece-runs")
    ahead, before = {}, 0
    for r in sorted(runs.groupBy("part").agg(F.sum("length").alias("size")).collect(), key=lambda r: r["part"]):  # one row a partition
        ahead[r["part"]], before = before, before + r["size"]
    return runs.select("doc_id", "doc_tokens", "start", "ids", "part", "before").mapInArrow(_lay(ahead, total, window, width, with_ids), _OUT + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with the sequence and offset where they lie; with_ids adds the ids as unsigned 32-bit little-endian bytes.

    weights are the sources' shares of a window; by default their shares of all tokens, so that all run out together. A
    source that runs out leaves its place to the others; one of no weight follows when the others have run out. Null text is an empty document of one token; a null source is a
    source, a missing source column one source; a null doc_id and repeated rows are documents of their own; further columns are ignored;
    an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    many = docs.select(source.alias("queue")).distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("queue"), "text")
    tokens = written(rows.mapInArrow(_tokenize(tokenizer), _TOKENS), "tokens")
    sums = written(tokens.groupBy("queue", "part").agg(F.sum("n").alias("size")), "queue-sums")
    width = Encoder(tokenizer or default_tokenizer()).kind.itemsize
    if many:
        return _pack_sorted(tokens, sums, weights, window, width, with_ids)
    totals = {r["queue"]: r["size"] for r in sums.groupBy("queue").agg(F.sum("size").alias("size")).collect()}  # MAX_QUEUES rows at most
    names = sorted(totals, key=lambda q: (q is None, q or ""))
    credits, _ = credits_of(totals, weights, window)
    rounds = Rounds([credits[q] for q in names], window)
    ahead = Window.partitionBy("queue").orderBy("part")
    starts = written(sums.select(F.col("queue").alias("q"), F.col("part").alias("p"), (F.sum("size").over(ahead) - F.col("size")).alias("ahead")), "queue-starts")
    placed = tokens.join(small(starts), F.expr("queue <=> q and part = p")).select("doc_id", "queue", (F.col("ahead") + F.col("local")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_place({q: k for k, q in enumerate(names)}, rounds, width, with_ids), _OUT + (", ids binary" if with_ids else ""))
