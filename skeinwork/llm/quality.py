"""Quality rules with thresholds that follow each language and source.

The base rule is fixed (too few words, or mostly repeated three-word windows). The adaptive part summarises five
measures of every document in quantile sketches, one per (lang, source): each value, an integer, falls into a
log-linear bucket (32 steps per power of two, so 3 % wide at most), and a sketch is the table of bucket counts. Such
sketches merge by adding counts, give the same answer in any order and on any retry, and are pre-aggregated before
the shuffle, so a source with a third of all rows costs what the others cost. A document is rejected where a measure
lies far beyond its group's median, in units of the group's own spread below the median.

Everything is DataFrame functions. Null text counts as empty and fails the base rule; null lang or source is a group
of its own; an empty table gives an empty result; equal rows are judged alike; groups under MIN_GROUP documents use their language's sketch, and languages under it the sketch of all.

Texts are taken whole, however long; ties at a threshold are kept, as a value must lie beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, free_name, stage, words

#: Documents that a group needs for thresholds of its own.
MIN_GROUP = 100
#: Spreads (median less tenth percentile) that a value may lie beyond its group's median.
REACH = 4
#: measure: least spread, in the measure's unit.
MEASURES = {"symbols": 12_000, "dup_lines": 100_000, "repeats": 100_000, "capitals": 40_000, "length": 700}
SYMBOLS = "#*$%&|<>"
#: Groups whose thresholds are broadcast, at 100 bytes each.
BROADCAST_GROUPS = 50_000


def with_measures(docs: DataFrame) -> DataFrame:
    """docs, whose names don't begin with q_, and the columns q_*: counts over whole texts, and the five measures as integers (parts per million, or
    thousandths of a code point for the mean word length)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("q_text", text)
    df = df.withColumn("q_words", words(F.col("q_text")))
    df = df.withColumn("q_n", F.size("q_words"))
    lines = F.filter(F.split("q_text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    df = df.withColumn("q_lines", lines)
    left = F.greatest(F.col("q_n") - 2, F.lit(0))
    part = lambda k: F.slice("q_words", k, left)
    # windows by 64-bit hash: two different windows of one text meet with a chance of n^2 / 2^65
    grams = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    df = df.withColumn("q_grams", F.when(F.col("q_n") < 3, F.array().cast("array<bigint>")).otherwise(grams))
    df = df.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_grams")) == F.size("q_grams"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("q_h", F.col("q_sorted.h")).withColumn("q_i", F.col("q_sorted.i"))
    none = F.array(F.lit(None).cast("bigint"))
    n = F.greatest(F.size("q_h") - 1, F.lit(0))
    near = F.arrays_zip(F.col("q_h").alias("h"), F.concat(none, F.slice("q_h", 1, n)).alias("p"), F.concat(F.slice("q_h", 2, n), none).alias("s"), F.col("q_i").alias("i"))
    twice = F.filter(near, lambda x: x["h"].isNotNull() & (x["h"].eqNullSafe(x["p"]) | x["h"].eqNullSafe(x["s"])))
    df = df.withColumn("q_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("q_twice", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    gone = lambda chars: F.length("q_text") - F.length(F.translate(F.col("q_text"), chars, ""))
    out = df.select(
        *docs.columns,
        F.col("q_n").cast("long").alias("q_n_words"),
        F.length(F.translate("q_text", SPACE, "")).cast("long").alias("q_word_chars"),
        gone(SYMBOLS).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        covered.cast("long").alias("q_n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        (F.length("q_text") - F.length(F.regexp_replace("q_text", r"\p{Lu}", ""))).cast("long").alias("q_capitals"),
    )
    share = lambda a, b: F.expr(f"coalesce({a} * 1000000 div nullif({b}, 0), 0)")
    return out.withColumns({
        "q_symbols": share("q_n_symbols", "q_word_chars"), "q_dup_lines": share("q_n_dup_lines", "q_n_lines"),
        "q_repeats": share("q_n_repeat_words", "q_n_words"), "q_capitals": share("q_capitals", "q_word_chars"),
        "q_length": F.expr("coalesce(q_word_chars * 1000 div nullif(q_n_words, 0), 0)"),
        "q_base_failed": F.expr("q_n_words < 50 OR 100 * q_n_repeat_words > 50 * q_n_words"),
    })


def bucket(v: Column) -> Column:
    """Bucket of a non-negative integer: exact below 64, then 32 steps per power of two; buckets keep the order."""
    bits = F.length(F.bin(v))
    over = F.greatest(bits - 6, F.lit(0))
    return over * 32 + F.call_function("shiftright", v, over)


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    over = F.greatest((b.cast("int") / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - over * 32).cast("long"), over)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches, one row per bucket that occurs. Documents that the
    base rule rejects don't take part."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"q_{m}")).alias("bucket")) for m in MEASURES]))
    return measured.where(~F.col("q_base_failed")).select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to `keys`, with the tenth percentile and the median of each: (keys, measure, docs, p10, p50)."""
    by = [*keys, "measure"]
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(w)).withColumn("docs", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bucket")))
    got = run.groupBy(*by).agg(F.max("docs").alias("docs"), at(10).alias("b10"), at(50).alias("b50"))
    return got.select(*by, "docs", bucket_floor(F.col("b10")).alias("p10"), bucket_floor(F.col("b50")).alias("p50"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with the highest kept value of every measure, and the lowest mean word length."""
    sketch = stage(sketches(measured), "quality-sketch")
    own, lang, every = (quantiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    groups = sketch.select("lang", "source", "measure").distinct().alias("g")
    o, a, e = own.alias("o"), lang.alias("a"), every.alias("e")
    same = lambda x, *cs: F.expr(" AND ".join(f"g.{c} <=> {x}.{c}" for c in cs))
    joined = groups.join(o, same("o", "lang", "source", "measure"), "left").join(a, same("a", "lang", "measure"), "left").join(e, same("e", "measure"), "left")
    pick = lambda c: F.expr(f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{c} WHEN a.docs >= {MIN_GROUP} THEN a.{c} ELSE e.{c} END")
    spread = F.greatest(F.col("p50") - F.col("p10"), F.expr("CASE measure " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in MEASURES.items()) + " END"))
    level = joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.measure").alias("measure"), pick("p10").alias("p10"), pick("p50").alias("p50"))
    level = level.withColumn("high", F.col("p50") + REACH * spread).withColumn("low", F.col("p50") - REACH * spread)
    return level.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"high_{m}") for m in MEASURES], F.max(F.when(F.col("measure") == "length", F.col("low"))).alias("low_length"))


def _judged(rows: DataFrame) -> DataFrame:
    """rows(row, text, lang, source) as (row, q_*): counts and measures, q_base_failed and q_kept. row is whatever is to
    be carried along; the text itself isn't."""
    measured = stage(with_measures(rows).drop("text"), "quality-measures")
    # one row per group; beyond the bound it is joined like any other table
    cut = stage(thresholds(measured), "quality-thresholds").withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    if cut.count() <= BROADCAST_GROUPS:
        cut = F.broadcast(cut)
    got = measured.join(cut, measured["lang"].eqNullSafe(cut["t_lang"]) & measured["source"].eqNullSafe(cut["t_source"]), "left")
    over = [F.coalesce(F.col(f"q_{m}") > F.col(f"high_{m}"), F.lit(False)) for m in MEASURES] + [F.coalesce(F.col("q_length") < F.col("low_length"), F.lit(False))]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    return got.withColumn("q_kept", ~F.col("q_base_failed") & ~bad).select("row", *[c for c in measured.columns if c.startswith("q_")], "q_kept")


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with q_* counts and measures, q_base_failed, and q_kept: whether the base rule and all thresholds hold. Extra
    columns stay as they are; where one is called like a q_ column, the new one gets a name with _ after it."""
    got = _judged(docs.select(F.struct("*").alias("row"), "text", "lang", "source"))
    return got.select("row.*", *[F.col(c).alias(free_name(docs, c)) for c in got.columns if c != "row"])


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    return _judged(docs.select(F.struct("*").alias("row"), "text", "lang", "source")).where("q_kept").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The contract of op10: one row per document."""
    got = _judged(docs.select(F.struct("doc_id").alias("row"), "text", "lang", "source"))
    return got.select("row.doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"), F.col("q_n_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))
