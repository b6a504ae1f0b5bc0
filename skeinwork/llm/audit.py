"""Audit of how filters overlap, by signed parity sums.

Every document has a mask of the filters that it fails. Spark adds up, per part and label, one signed parity sum for each
of the 2^k sets T of filters: documents count 1, or -1 if they fail an odd number of the filters in T. These sums, a
Walsh-Hadamard transform, merge by addition and are pre-aggregated before the shuffle, so a part with a third of all rows
costs what the others cost. The transform is its own inverse but for the factor 2^k, so whole-number division gives back
exactly how many documents have each mask. From these cells all k! orders follow without another look at the documents,
and so do Shapley shares: of the k! orders, a document that fails m filters is removed by each of them in k! / m.

The filters: A under 50 words, B few distinct words, C many capitals, D odd characters, E a text that some smaller doc_id
has too. E needs the whole table: texts meet by SHA-256, and a document is free of E if it holds the smallest id of its
text, which is a join on (digest, id), so that a text in a third of all rows is spread by its ids.

Null texts are empty texts, and equal to them. A null source is the part '', as an empty one is. Rows that repeat count
each; rows of one doc_id aren't smaller than each other; rows without a doc_id have no label, and neither fail E nor make
others fail it. A doc_id with several labels is good or toxic if any of them says so. Long texts are worked on whole. An
empty table has no parts and gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, words

FILTERS = "ABCDE"


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, part, mask, n) from documents: rows with the same id, text and part together; the mask has the bits of
    filters A to D, 1 to 8."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    d = d.withColumn("ws", words(F.col("text")))
    n = F.size("ws")
    fails = [
        n < 50,
        100 * F.size(F.array_distinct("ws")) < 65 * n,
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 5 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    d = d.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", mask.alias("mask"))
    return d.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): documents with the whole masks, E (16) among them, and their labels."""
    units = stage(failures(docs), "audit-units")
    named = units.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    got = named.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    got = got.select("part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), "n")
    # ids that are null join with nothing, and would all meet in one task
    return got.unionByName(units.where("doc_id IS NULL").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n"))


def _sign(mask: Column, subset: int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def parity_sums(masked: DataFrame, k: int) -> DataFrame:
    """(part, good, toxic, sums): the 2^k signed sums of masked(part, good, toxic, mask, n), by subset."""
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), t)).alias(f"s{t}") for t in range(1 << k)]
    return masked.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{t}" for t in range(1 << k)]).alias("sums"))


def cells(sums: DataFrame, k: int) -> DataFrame:
    """(part, every, good, toxic): documents of each mask, by inversion of the sums of (part, good, toxic, sums); all of
    them, and those with the labels."""
    signs = F.array(*[F.array(*[F.lit((-1) ** (m & t).bit_count()) for t in range(1 << k)]) for m in range(1 << k)])
    dot = lambda row: F.aggregate(F.zip_with(row, "sums", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    inverse = F.transform(signs, lambda row: F.call_function("shiftright", dot(row), F.lit(k)))
    each = sums.select("part", "good", "toxic", inverse.alias("cell"))
    add = lambda c, on: F.sum(F.when(on, F.get("cell", F.lit(c))).otherwise(0)).alias(f"{c}")
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    out = each.groupBy("part").agg(*[F.struct(*[add(c, on) for c in range(1 << k)]).alias(name) for name, on in kinds.items()])
    return out.select("part", *[F.array(*[F.col(f"{name}.`{c}`") for c in range(1 << k)]).alias(name) for name in kinds])


def orders(found: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Every order and step of `letters` for each part of found(part, every, good, toxic)."""
    k = len(letters)
    steps = [(("".join(p)), i + 1, 1 << letters.index(p[i]), sum(1 << letters.index(x) for x in p[:i])) for p in permutations(letters) for i in range(k)]
    said = F.split(F.lit(",".join(f"{o}:{i}:{f}:{b}" for o, i, f, b in steps)), ",")
    part = lambda x, at: F.get(F.split(x, ":"), at)
    rows = found.withColumn("step_", F.explode(said)).select(
        "part", part(F.col("step_"), 0).alias("filter_order"), part(F.col("step_"), 1).cast("int").alias("step"), part(F.col("step_"), 2).cast("int").alias("own"), part(F.col("step_"), 3).cast("int").alias("before"), "every", "good", "toxic"
    )
    own = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0

    def total(name: str, on, weight=lambda m: F.lit(1)) -> Column:
        counted = F.transform(name, lambda x, m: F.when(on(m), x * weight(m)).otherwise(0))
        return F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x)

    now = lambda m: own(m) & ~gone(m)
    share = lambda m: F.expr(f"{math.factorial(k)}L") / F.greatest(F.bit_count(m), F.lit(1))
    return rows.select(
        "part", "filter_order", "step",
        total("every", lambda m: ~own(m) & ~gone(m)).alias("kept"),
        total("every", now).alias("removed"),
        total("every", lambda m: own(m) & gone(m)).alias("redundant"),
        F.get("every", F.col("own")).alias("unique_fails"),
        total("good", now).alias("good_lost"),
        total("toxic", now).alias("toxic_lost"),
        total("every", own, lambda m: share(m).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module."""
    # cells are 2^k numbers a part, however many documents there are, and 5 k! rows come of them
    return orders(stage(cells(parity_sums(masks(docs, labels), len(FILTERS)), len(FILTERS)), "audit-cells"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op12: 600 rows per source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
