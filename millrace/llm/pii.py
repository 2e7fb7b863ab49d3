"""Personal data: candidate spans, chosen by gradient boosted trees.

Spans of the base patterns always stay. High-recall generators propose further, overlapping spans: obfuscated
addresses, numbers written like phones, cards or identity numbers, and secrets. Boosted trees score each by its
format and its context; a candidate is taken if its calibrated probability reaches its kind's threshold, the
likeliest first, unless it overlaps a span that is already there. The trees are trained here, on examples
that a seeded rule writes.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("address", "contact", "identity", "account", "secret")
TARGET_PRECISION = 0.98
CONTEXT = 24

# The base patterns, written so that a failing run of digits is scanned once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches by their at signs: the local part is the whole run before it, so no run is scanned twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind as listed, then start."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


_AT = r"(?:@|[\[(]\s?at\s?[\])])"
_HAS_AT = re.compile(_AT, re.I)
_OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?" + _AT + r"\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]++)*+", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[(]?[0-9](?:[ ().-]{0,2}[0-9])*+")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}+(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")


def candidates(text: str) -> list[Span]:
    """Everything that might be personal data beside the base spans, overlaps included.

    A text is passed over only for want of what every match of a pattern holds: an at sign in some writing, a digit. Each pattern takes a whole run, however
    long; numbers have 7 digits at least, 19 at most (the longest card).
    """
    out: list[Span] = []
    if _HAS_AT.search(text):
        out += [("address", *m.span()) for m in _OBFUSCATED.finditer(text)]
    if re.search("[0-9]", text):
        for m in _NUMBER.finditer(text):
            n = len(digits_of(m[0]))
            if not 7 <= n <= 19 or text[m.end() : m.end() + 1].isalnum() and text[m.end()].isascii():
                continue
            if n <= 15:
                out.append(("contact", *m.span()))
            if n == 9 or n >= 13:
                out.append(("identity", *m.span()))
        out += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
        out += [("secret", *m.span()) for m in _SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return out


# Words whose presence just before a span hints at a kind.
_HINTS = (
    re.compile(r"phone|call|tel|fax|mobile|cell", re.I), re.compile(r"mail|contact|write", re.I), re.compile(r"ssn|social|passport|identity|licen[cs]e no", re.I),
    re.compile(r"card|visa|credit|amex", re.I), re.compile(r"iban|account|bank", re.I), re.compile(r"token|secret|api|key|password|bearer", re.I), re.compile(r"order|invoice|version|page|isbn|total|commit|sha|hash|id\b|sum", re.I),
)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    kind, start, end = span
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 2]
    digits = digits_of(s)
    counts = Counter(s)
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values())
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    last = before.rstrip()[-1:]
    return [
        float(EXTRA_KINDS.index(kind)), len(s), len(digits), len(digits) / len(s), entropy, float(len(groups)), float(max(groups, default=0)), float(groups == [3, 2, 4]), float(luhn(digits)) if digits else 0.0,
        sum(c in "0123456789abcdefABCDEF" for c in s) / len(s), float(s.upper() == s), float(s.count("-")), float(s.count(".")), float("(" in s), float("@" in s), float(bool(re.search(r"\.|dot", s))),
        float(last == "="), float(last == ":"), float(last in "\"'`" and bool(last)), float(last in "#$" and bool(last)), float(after[:1] == "%"), *[float(bool(h.search(before))) for h in _HINTS],
    ]


def _examples(n: int = 3000, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in sentences that a rule writes: personal data and what looks like it."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k=k))
    private = (
        lambda: f"{rng.choice(['mail', 'contact', 'write to', 'e-mail:'])} {word()} (at) {word()} (dot) com", lambda: f"mail {word()}[at]{word()}[dot]org",
        lambda: f"{rng.choice(['phone', 'call', 'tel', 'fax', 'mobile'])}{rng.choice(['', ':'])} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{rng.choice(['phone:', 'call', 'tel.'])} {digit(3)}-{digit(3)}-{digit(4)}", lambda: f"call 0{digit(3)} {digit(6)}",
        lambda: f"{rng.choice(['ssn', 'SSN:', 'social security'])} {digit(3)}-{digit(2)}-{digit(4)}", lambda: f"{rng.choice(['passport', 'identity number'])} {digit(9)}", lambda: f"{rng.choice(['card', 'visa', 'credit card:'])} {digit(15)}",
        lambda: f"{rng.choice(['iban', 'IBAN:', 'account'])} {rng.choice(['DE', 'FR', 'ES', 'GB'])}{digit(2)} {digit(4)} {digit(4)} {digit(4)} {digit(4)} {digit(2)}",
        lambda: f"{rng.choice(['token', 'secret', 'api_key', 'key', 'password'])} = \"{hexa(rng.choice([32, 40, 64]))}\"", lambda: f"{rng.choice(['token', 'secret', 'api key', 'bearer'])}{rng.choice([':', '=', ' '])} {mixed(rng.randint(24, 48))}",
    )
    public = (
        lambda: f"{word()} @ {word()}", lambda: f"{word()} {digit(rng.randint(7, 15))}", lambda: f"order {digit(rng.randint(7, 12))}", lambda: f"total ${digit(4)}.{digit(4)}", lambda: f"version {digit(2)}.{digit(3)}.{digit(4)}", lambda: f"isbn 978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}",
        lambda: f"in {digit(4)}-{digit(2)}-{digit(2)} {word()}", lambda: f"{word()} {digit(3)} {digit(3)} {digit(3)}", lambda: f"{word()} {digit(16)} {word()}", lambda: f"{word()} {digit(4)}-{digit(4)} {word()}", lambda: f"AB{digit(2)} {digit(4)} {digit(4)} {word()}",
        lambda: f"commit {hexa(40)}", lambda: f"sha {hexa(64)}", lambda: f"{word()} {'-'.join(word() for _ in range(6))}-{digit(1)}", lambda: f"{word()}{'=' * 24}{digit(1)}a", lambda: f"/{word()}/{word()}{digit(2)}/{word()}_{word()}/{word()}",
    )
    rows, labels, kinds = [], [], []
    for _ in range(n):
        for templates, label in ((private, 1), (public, 0)):
            text = f"{word()} {word()} {rng.choice(templates)()} {word()}"
            for span in candidates(text):
                rows.append(features(text, span))
                # a private number is of the kind its words name; the other reading of it is not
                right = label and not (span[0] == "identity" and re.search("phone|call|tel|fax|mobile", text)) and not (span[0] == "contact" and re.search("ssn|SSN|social|passport|identity|card|visa|iban|IBAN|account", text))
                labels.append(int(bool(right)))
                kinds.append(EXTRA_KINDS.index(span[0]))
    return np.array(rows), np.array(labels, float), np.array(kinds)


class Trees:
    """Boosted depth-3 trees on the logistic loss, with Platt calibration and a threshold for each kind."""

    depth, rounds, rate = 3, 40, 0.3

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> None:
        held = np.arange(len(y)) % 4 == 3
        self.cuts = [np.unique(np.quantile(x[~held][:, k], np.linspace(0.02, 0.98, 25))) for k in range(x.shape[1])]
        self.trees: list[list[tuple[int, float]]] = []
        self.values: list[np.ndarray] = []
        f = np.zeros(int((~held).sum()))
        xt, yt = x[~held], y[~held]
        bins = np.stack([np.searchsorted(c, xt[:, k], side="left") for k, c in enumerate(self.cuts)], 1)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = yt - p, p * (1 - p)
            leaf = np.zeros(len(yt), int)
            tree: list[tuple[int, float]] = []
            for level in range(self.depth):  # one split for all nodes of a level
                best = (-1.0, 0, 0)
                for k, c in enumerate(self.cuts):
                    width = len(c) + 1
                    gs = np.bincount(leaf * width + bins[:, k], g, width << level).reshape(-1, width).cumsum(1)
                    hs = np.bincount(leaf * width + bins[:, k], h, width << level).reshape(-1, width).cumsum(1)
                    gain = (gs[:, :-1] ** 2 / (hs[:, :-1] + 1) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1)).sum(0)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
                tree.append((best[1], float(self.cuts[best[1]][best[2]])))
                leaf = leaf * 2 + (bins[:, best[1]] > best[2])
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            self.trees.append(tree)
            self.values.append(value)
            f += value[leaf]
        raw = self.raw(x[held])
        self.a, self.b = 1.0, 0.0
        for _ in range(200):  # Platt: a logistic curve over held-out scores
            p = 1 / (1 + np.exp(-(self.a * raw + self.b)))
            self.a += 0.05 * float(np.mean((y[held] - p) * raw))
            self.b += 0.05 * float(np.mean(y[held] - p))
        p = self.probability(x[held])
        self.thresholds = np.full(len(EXTRA_KINDS), 0.9)
        for k in range(len(EXTRA_KINDS)):
            own = kinds[held] == k
            for t in np.linspace(0.5, 0.99, 50):
                taken = own & (p >= t)
                if taken.any() and y[held][taken].mean() >= TARGET_PRECISION:
                    self.thresholds[k] = t
                    break

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.zeros(len(x))
        for tree, value in zip(self.trees, self.values, strict=True):
            leaf = np.zeros(len(x), int)
            for k, cut in tree:
                leaf = leaf * 2 + (x[:, k] > cut)
            f += value[leaf]
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.raw(x) + self.b)))


@lru_cache(maxsize=1)
def trained() -> Trees:
    return Trees(*_examples())


def find_spans(text: str | None, trees: Trees) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: kinds as listed (base, then further ones), then start."""
    text = text or ""
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, base
    x = np.array([features(text, s) for s in proposed])
    p = trees.probability(x)
    taken = list(base)
    covered = bytearray(len(text))
    for _, start, end in base:
        covered[start:end] = b"\1" * (end - start)
    for k in np.lexsort((np.arange(len(p)), -p)).tolist():
        kind, start, end = proposed[k]
        if p[k] >= trees.thresholds[EXTRA_KINDS.index(kind)] and covered.find(1, start, end) < 0:
            taken.append(proposed[k])
            covered[start:end] = b"\1" * (end - start)
    kinds = (*BASE_KINDS, *EXTRA_KINDS)
    return base, sorted(taken, key=lambda s: (kinds.index(s[0]), s[1]))


def spans_text(spans: list[Span]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def redact_text(text: str | None, trees: Trees) -> str | None:
    """Each span, overlapping ones joined, replaced by its kind in brackets."""
    if not text:
        return text
    _, spans = find_spans(text, trees)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document; null text counts as empty.

    No row depends on another: repeated rows and null ids are searched one by one, further columns are
    ignored, an empty table gives no rows. Every pattern takes time in proportion to the text.
    """
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(trained())  # some kilobytes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, listed = [], []
            for text in batch.column(1).to_pylist():
                base, spans = find_spans(text, trees)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                listed.append(spans_text(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars, if there, counted anew where a text changed.

    Null and empty texts stay, and so do all other columns, whatever their names; rows are changed one by one, repeated ones and null ids too; an
    empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(trained())
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(at).to_pylist()
            texts = [redact_text(t, shipped.value) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([c if a == b else len(b) for c, a, b in zip(old, before, texts, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(change, docs.schema)
