"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of shuffled documents, repeated up to MAX_COPIES times. A document's virtual
finish time is the source's cumulative tokens divided by the source's target, so that time 1 is where each
source has given its target and all together the budget; the mix is the global order by finish time, truncated
at the budget, that is at time 1. The document that a source is giving at that time gives its first words only. timeline() says this once;
mix() emits its copies in order, mixed_share() adds them up for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import small, written

MAX_COPIES = 3
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float | None = None) -> DataFrame:
    """(source, source_size) -> + target: shares by weight, none above MAX_COPIES times its size.

    The weights go round the sources by code point, null last. Resharing the excess by weight until none
    is above settles where target = min(3 x size, level x weight), so the level follows from sources sorted
    by size over weight. The table has one row a source; the two windows run over those rows alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1)
    t = sizes.withColumn("w", w).withColumn("most", F.lit(float(MAX_COPIES)) * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    total = F.sum("source_size").over(every).cast("double") if budget is None else F.least(F.lit(float(budget)), F.sum("most").over(every))
    t = t.withColumn("total", total)
    t = t.withColumn("below", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest_w", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("below")) / F.col("rest_w"))
    # the first source, in that order, whose bound is not reached sets the level of all behind it
    free = F.min(F.when(F.col("most") > F.col("level") * F.col("w"), F.struct((F.col("most") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(every)
    return t.withColumn("free", free["level"]).select("source", "source_size", F.coalesce(F.least("most", F.col("free") * F.col("w")), F.col("most")).alias("target"))


def timeline(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, docs_per_bin: int = 500, budget: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc (a struct of its columns, or of those to keep), size, source_size, target, order, and served: a (copy, words, finish) for each copy in the mix.

    The shuffled order of a source is by a 60-bit hash of doc_id and text, then doc_id. Prefix sums take two levels: the
    hash deals each source into bins of about docs_per_bin documents, which follow each other in its order; sums of bins are added
    up over one short row for each bin, and documents only within their bin, so a source with a third of all rows is
    spread like any other and the number of bins does not change a result.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "text").cast("binary"))
    doc = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])
    named = [F.coalesce("source", F.lit("")).alias("queue"), F.col("source").isNull().alias("none")]
    sized = docs.select(doc.alias("doc"), *named, "doc_id", word_count(F.col("text")).alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("order"))
    n = docs.count()
    bins = max(16, min(1 << 20, n // docs_per_bin))
    sized = sized.withColumn("bin", F.shiftright(F.shiftright("order", 40) * F.lit(bins), 20))
    key = ["queue", "none"]
    sums = written(sized.groupBy(*key, "bin").agg(F.sum("size").alias("sum")), "mix-bins")
    before = Window.partitionBy(*key).orderBy("bin")
    bin_starts = sums.select(*key, "bin", (F.sum("sum").over(before) - F.col("sum")).alias("start"))
    sizes = sums.groupBy(*key).agg(F.sum("sum").alias("source_size")).select(F.when(~F.col("none"), F.col("queue")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, budget).select(F.coalesce("source", F.lit("")).alias("queue"), F.col("source").isNull().alias("none"), "source_size", "target")
    starts = small(written(bin_starts.join(targets, key), "mix-starts"))
    inner = Window.partitionBy(*key, "bin").orderBy("order", F.col("doc_id").asc_nulls_last())
    placed = sized.withColumn("inside", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # a broadcast, or a join on the window's own keys: texts are not shuffled for it
    joined = placed.join(starts, [*key, "bin"], "left").withColumn("ahead", F.col("start") + F.col("inside"))
    cut = F.round("target").cast("long")

    def served(c: int) -> Column:
        begin = F.col("ahead") + F.lit(c).cast("long") * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut - begin))
        return F.struct(F.lit(c).cast("long").alias("copy"), words.alias("words"), F.least(F.lit(1.0), (begin + words) / F.col("target")).alias("finish"))

    copies = F.filter(F.array(*[served(c) for c in range(MAX_COPIES)]), lambda x: x["words"] > 0)
    return joined.select("doc", "size", "source_size", "target", "order", copies.alias("served"))


def mixed_share(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document: the words of it that the mix emits, repeats counted.

    Null text and empty text have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows are
    documents of their own; ties in the shuffled order are of equal documents alone; further columns, whatever their names, do not matter; an empty
    table gives no rows.
    """
    taken = F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return timeline(docs.select("doc_id", "text", "source"), keep=["doc_id", "source"], **how).select("doc.doc_id", "doc.source", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n.cast("int")), "")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus in order of finish time: doc (a struct of docs' columns), copy, words, finish; a row for each copy taken.

    A copy at its source's cut has a text of its first words only, and an n_chars, if there is one, to match. Documents of no words are never
    taken; null sources, repeated rows, ties and an empty table are as in mixed_share. Columns of any name come out as they went in.
    """
    copies = timeline(docs, **how).select("doc", "size", "order", F.explode("served").alias("c"))
    whole = F.col("c.words") == F.col("size")
    text = first_words(F.col("doc.text"), F.col("c.words"))
    cut = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    timed = copies.select(F.when(whole, F.col("doc")).otherwise(cut).alias("doc"), "c.copy", "c.words", "c.finish", "order")
    return timed.repartitionByRange("finish", "order").sortWithinPartitions("finish", "order").drop("order")
