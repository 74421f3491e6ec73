"""Quality rules with adaptive thresholds, in SQL functions only.

Each text is measured; the measures are counted into quantile sketches per language and source, and a document
is rejected where it lies outside the fences that the sketches of its own group give.

A sketch is a histogram whose buckets keep the leading bits of a number, so a quantile is known to a thirty-second part.
Sketches of any parts merge by adding counts: the result does not depend on partitions or on the order of merging.

Defined results: null text has no words and fails the base rules; null language or source is a group of its own;
a document without doc_id is judged like any other; repeated rows are judged one by one; an empty table gives an
empty result.  Columns of other names are carried along untouched, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import landed
from .text import BLANK_RE, let, word_array

LEAD_BITS = 6
#: Fewest documents of a (language, source) group with fences of its own; smaller ones use the language's, then all.
LEAST_DOCS = 200
#: A fence lies beyond a high (or low) quantile of the group's own sketch, as many times further as the quantile is away
#: from the median: (measure, lower side, quantile per mille, times).  Both are read as the outer edges of their buckets, which
#: is all the margin there is.  Junk may be a tenth of a group in the first three; repeated text has a long tail of its own.
FENCES = [
    ("word_length", False, 900, 3),  # hundredths of a character per word
    ("word_length", True, 100, 3),
    ("symbols", False, 900, 3),  # per 1000 words
    ("dup_lines", False, 990, 3),  # per 1000 words
    ("repeats", False, 990, 2),  # words in repeated windows, per 1000 words
]
MEASURES = list(dict.fromkeys(m for m, *_ in FENCES))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows; windows are compared by them."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))


def covered(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more: equal windows are neighbours once sorted with their positions."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda p: F.sort_array(
        F.transform(F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])), lambda x: x["i"])
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    return let(placed, lambda p: F.aggregate(twice(p), start, step, lambda acc: acc["n"]))


def repeated_words(hashes: Column) -> Column:
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` and the measures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^" + BLANK_RE[1:]))
    d = docs.select(
        *keep,
        let(
            word_array(text),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(window_hashes(w)).alias("n_repeat_words")
            ),
        ).alias("_w"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    names = d.columns[: len(keep)]
    d = d.select(*names, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _measure_values() -> dict[str, Column]:
    """Whole numbers, so that buckets are exact everywhere.

    A text without words fails the base rules before they count, but Spark works out what two fences share beforehand, for all rows.
    """
    per = lambda c, k: F.expr(f"({k} * {c}) div greatest(n_words, 1)")
    return {"word_length": per("word_chars", 100), "symbols": per("n_symbols", 1000), "dup_lines": per("n_dup_lines", 1000), "repeats": per("n_repeat_words", 1000)}


def _bucket(x: str) -> Column:
    """Smallest number with the same leading bits."""
    return F.expr(f"shiftleft(shiftright({x}, greatest(0, length(bin({x})) - {LEAD_BITS})), greatest(0, length(bin({x})) - {LEAD_BITS}))")


def sketches(m: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket) of documents that pass the base rules."""
    values = _measure_values()
    rows = m.filter(~F.col("base_failed")).select(
        "lang", "source", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()]))
    )
    return rows.groupBy("lang", "source", "measure", _bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def _side(measure: str, low: bool) -> str:
    return f"{measure}_{'low' if low else 'high'}"


def fences(sk: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, source): the fences of its own sketch, or of the smallest merged one that is large enough."""
    sizes = sk.filter(F.col("measure") == MEASURES[0]).groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    groups = sizes.withColumn("lang_docs", F.sum("docs").over(Window.partitionBy("lang"))).withColumn(
        "level", F.when(F.col("docs") >= least_docs, 0).when(F.col("lang_docs") >= least_docs, 1).otherwise(2)
    )
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("pool_lang"), F.col("source").alias("pool_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("pool_lang"), F.lit(None).cast("string").alias("pool_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("pool_lang"), F.lit(None).cast("string").alias("pool_source")),
    )
    merged = sk.select("measure", "bucket", "n", F.inline(levels)).groupBy("level", "pool_lang", "pool_source", "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("level", "pool_lang", "pool_source", "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    edge = F.col("bucket") + F.expr(f"shiftleft(1L, greatest(0, length(bin(bucket)) - {LEAD_BITS}))")
    reached = lambda per_mille: 1000 * F.col("upto") >= per_mille * F.col("total")

    def fence(measure: str, low: bool, per_mille: int, times: int) -> Column:
        at = lambda q, value: F.min(F.when((F.col("measure") == measure) & reached(q), value))
        if low:
            return at(per_mille, F.col("bucket")) * (1 + times) - times * at(500, edge)
        return at(per_mille, edge) * (1 + times) - times * at(500, F.col("bucket"))

    pools = ranked.groupBy("level", "pool_lang", "pool_source").agg(*[fence(*f).alias(_side(*f[:2])) for f in FENCES])
    g, p = groups.alias("g"), pools.alias("p")
    same = (
        (F.col("g.level") == F.col("p.level"))
        & F.when(F.col("g.level") < 2, F.col("g.lang")).eqNullSafe(F.col("p.pool_lang"))
        & F.when(F.col("g.level") < 1, F.col("g.source")).eqNullSafe(F.col("p.pool_source"))
    )
    return g.join(p, same).select(F.col("g.lang").alias("fence_lang"), F.col("g.source").alias("fence_source"), *["p." + _side(*f[:2]) for f in FENCES])


def judged(docs: DataFrame, carry: bool = False, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each document; with ``carry`` also its whole row as ``row``.

    The measures are written once to the shared folder: the sketches and the verdicts read them from there.
    """
    for c in ("lang", "source"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
    keep = [F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")] + ([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [])
    m = landed(measured(docs, keep), "quality")
    f = fences(sketches(m), least_docs)
    inside = F.lit(True)
    values = _measure_values()
    for name, low, *_ in FENCES:
        fence = F.col(_side(name, low))
        inside = inside & ((values[name] >= fence) if low else (values[name] <= fence))
    out = m.join(f, m["lang"].eqNullSafe(f["fence_lang"]) & m["source"].eqNullSafe(f["fence_source"]), "left")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"] + (["row"] if carry else [])
    return out.select(*names, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """Rows of ``docs`` that the rules keep, unchanged."""
    return judged(docs, carry=True, **kw).filter("kept").select("row.*")
