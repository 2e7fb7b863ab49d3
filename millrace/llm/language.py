"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A document, reduced to its letters, is
encoded block by block with every dictionary; the language of the smallest total wins. The margin between
the two smallest totals gives the score, and a narrow one rejects the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, prepare

SAMPLE_DOCS = 300
"""Documents of each language that give a window of their text to its dictionary."""
SAMPLE_CHARS = 160_000
"""Characters of a language's windows together: each of n documents gives a window of SAMPLE_CHARS / n, drawn anywhere in its whole text."""
BLOCK = 4096
REJECT = 0.004
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-case words of letters; a word that repeats at once is said once."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).split()
    return " ".join([w for w, before in zip(words, [None, *words], strict=False) if w != before])


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.languages = sorted(samples)
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=18, hash_log=15, chain_log=16, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.coders = [self._coder(samples[name], params) for name in self.languages]

    @staticmethod
    def _coder(sample: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def sizes(self, letters: str) -> list[int]:
        data = f" {letters} ".encode("utf-8", "surrogatepass")
        totals = [0] * len(self.coders)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            for k, coder in enumerate(self.coders):
                totals[k] += len(coder.compress(block))
        return totals

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0 to 1, and whether the margin is too narrow (or there is no letter)."""
        letters = letters_of(text)
        if not letters or not self.coders:
            return UNKNOWN, 0.0, True
        totals = self.sizes(letters)
        best = min(range(len(totals)), key=totals.__getitem__)
        rest = min((t for k, t in enumerate(totals) if k != best), default=2 * totals[best])
        margin = (rest - totals[best]) / rest
        return self.languages[best], min(1.0, 0.5 + 4 * margin), margin < REJECT


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary text of each language, from a bounded sample of rows that may be learned from.

    The driver gets a count for each language, and SAMPLE_CHARS characters of each, drawn by hashes of doc_id.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~fold_of("doc_id") & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return {}
    of = lambda value: F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(value(c)))])[F.col("lang")]
    width = of(lambda c: SAMPLE_CHARS // min(SAMPLE_DOCS, c))
    drawn = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))).where(F.col("_h") < of(lambda c: min(1_000_000_000, 1_500_000_000 * SAMPLE_DOCS // c + 1)))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    got = drawn.select("lang", "_h", F.substring("text", start, width).alias("part")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_h"], r["part"])):
        own = samples.setdefault(r["lang"], [])
        if len(own) < SAMPLE_DOCS and (letters := letters_of(r["part"])):
            own.append(letters.encode("utf-8", "surrogatepass"))
    return {k: b" ".join(v) for k, v in samples.items() if v}


def identify(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of texts (docs by default), learning from docs.

    Rows whose crc32(doc_id) mod 3 is 1 and rows of null lang or text are not learned from; lang, source and doc_id do not
    enter a prediction; a null doc_id is not held out. Null, empty and letterless texts are `und`, rejected, with score 0, and so is everything if
    nothing can be learned; equal sizes go to the first language by code point; repeated rows are
    predicted one by one; further columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    samples = spark.sparkContext.broadcast(learn(docs))  # SAMPLE_CHARS a language

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(samples.value)
        for batch in batches:
            got = [coders.classify(t) for t in batch.column(2).to_pylist()]
            langs, scores, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = (docs if texts is None else texts).select(F.col("doc_id").cast("long").alias("doc_id"), fold_of("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is unknown or rejected; all columns, whatever their names, stay as they are.

    Null, empty and letterless texts go; where nothing can be learned every row goes; null doc_ids and repeated rows are judged one by one, by their text;
    an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    samples = spark.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Compressors(samples.value)
        for batch in batches:
            yield batch.filter(pa.array([not coders.classify(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
