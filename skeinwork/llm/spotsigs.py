"""Document fingerprints from spot signatures, in DataFrame functions throughout.

A signature is a common word (an anchor) with the next CHAIN content words after it, common words left out between
them. Common words follow prose and not menus or boilerplate, so a fingerprint, the set of a text's signatures, follows
its natural-language passages. Each signature is a 64-bit hash; two texts compare by Jaccard similarity of their sets.
A text without a full chain has its three-word windows as signatures, with fewer words the hash of the whole text, so
only equal texts are alike then. Null counts as empty.

Repeated rows and ties of doc_id are ordered by text; rows without a doc_id come last, and an empty table gives an empty
result. Extra columns aren't read by the query, and are carried along by the helpers whatever they are called.

Texts are taken whole, however long: a fingerprint grows with its text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, stage

#: Content words in a chain.
CHAIN = 2
# Frequent words of English, German, French and Spanish.
ANCHORS = frozenset("""
a an and are as at be been but by can do for from had has have he her his if in is it its not of on or she so that the
their there they this to was we were which will with would you
als am auch auf aus bei bin das dass dem den der des die dir du ein eine einem einen einer es für hat ich ihr im ist mit
nach nicht noch nur oder sich sie sind so um und uns vom von vor war wie wir zu zum zur über
au aux avec ce ces dans de du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se
ses son sur un une vous
al como con de del el ella en entre era es esta este ha la las lo los más me mi muy no o para pero por que se sin su sus
también todo un una y ya yo
""".split())
#: Characters of a bucket of neighbouring documents, about, and the most buckets.
BUCKET, BUCKETS = 1 << 22, 1 << 17


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the signature set of column `text`, sorted, one at least."""
    names = {k: free_name(df, f"{out}_{k}") for k in ("w", "a", "c", "s")}
    w, a, c, s = names.values()
    keep = df.columns
    df = df.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    common = lambda x: x.isin(*sorted(ANCHORS))
    marked = F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"), common(x).alias("common")))
    df = df.withColumn(s, marked)
    df = df.withColumn(a, F.filter(s, lambda x: x["common"])).withColumn(c, F.array_compact(F.transform(s, lambda x: F.when(~x["common"], x["x"]))))
    # the k-th anchor, at place i, has i - k content words before it
    follow = lambda x, k, j: F.get(c, x["i"] - k + j)
    chains = F.transform(a, lambda x, k: F.when(x["i"] - k + CHAIN <= F.size(c), F.xxhash64(x["x"], *[follow(x, k, j) for j in range(CHAIN)])))
    df = df.withColumn(s, F.array_sort(F.array_distinct(F.array_compact(chains))))
    n = F.size(w)
    part = lambda k: F.slice(w, k, F.greatest(n - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    whole = F.array(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    sigs = F.when(F.size(s) > 0, F.col(s)).when(n >= 3, F.array_sort(F.array_distinct(windows))).otherwise(whole)
    return df.select(*keep, sigs.alias(out))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: 16 hex digits per signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_signatures, class_id, links) of every row: its class are the rows with the same signature set, class_id
    is their smallest doc_id, and links counts the other classes with a similarity of `threshold` or more; see near_pairs.
    Repeated rows come as often as they are there, and rows without a doc_id are compared like all others."""
    signed = _signed(docs)
    sets = _sets(signed)
    pairs = _alike(sets, threshold)
    links = pairs.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    known = sets.select("c", "class_id", "n").join(links, "c", "left")
    return signed.select("doc_id", "c").join(known, "c").select("doc_id", F.col("n").cast("long").alias("n_signatures"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs of signature classes, each under its smallest doc_id (null if none of its rows has one),
    that are alike.

    Sets are partitioned by length: bounds grow by 1/threshold, so a set meets only its own partition and the next.
    Within these, two sets meet only over one of the hashes that a pair at the threshold can't all miss: the first
    n - ceil(threshold * n) + 1 of each in the order of how many sets hold them, the rarest first, so that passages which
    many texts share come last and seldom bring two sets together. Hashes that one set alone holds come before all others
    and can't bring it to any other, so only their number is kept. The lengths must fit before a pair's similarity is
    worked out. A hash that still is in very many sets is a skewed join key, which adaptive execution splits."""
    sets = _sets(_signed(docs))
    name = lambda c, i: sets.select(F.col("c").alias(c), F.col("class_id").alias(i))
    got = _alike(sets, threshold).join(name("c1", "i"), "c1").join(name("c2", "j"), "c2")
    ordered = F.array_sort(F.array("i", "j"))
    return got.select(ordered[0].alias("a"), ordered[1].alias("b"), "similarity")


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, c, sigs) of every row, written; c names the signature set by two hashes."""
    rows = with_signatures(docs.select("doc_id", "text"), "text", "sigs")
    return stage(rows.select("doc_id", F.struct(F.xxhash64("sigs").alias("h"), F.hash("sigs").alias("k")).alias("c"), "sigs"), "spot-sigs")


def _sets(signed: DataFrame) -> DataFrame:
    """(c, class_id, sigs, n): the distinct signature sets, written."""
    return stage(signed.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.any_value("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "spot-sets")


def _alike(sets: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2, similarity) of the sets that are alike, once a pair, written."""
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    take = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    held = sets.select("c", "n", F.explode("sigs").alias("sig"))
    often = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("held")).where("held > 1")
    shared = held.join(often, "sig").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("held", "sig"))).alias("order"))
    alone = F.col("n") - F.size("order")
    first = F.slice(F.col("order")["sig"], F.lit(1), F.greatest(take - alone, F.lit(0)))
    keys = stage(shared.select("c", "n", part.alias("part"), F.explode(first).alias("sig")), "spot-keys")
    small = keys.select(F.col("c").alias("c1"), F.col("n").alias("n1"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    big = keys.select(F.col("c").alias("c2"), F.col("n").alias("n2"), "sig", "part")
    fits = (F.col("n1") >= F.col("n2") * threshold) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2"))))
    met = small.join(big, ["part", "sig"]).where(fits).select("c1", "c2").distinct()
    s1 = sets.select(F.col("c").alias("c1"), F.col("sigs").alias("x"))
    s2 = sets.select(F.col("c").alias("c2"), F.col("sigs").alias("y"))
    scored = met.join(s1, "c1").join(s2, "c2").select("c1", "c2", likeness(F.col("x"), F.col("y")).alias("similarity"))
    return stage(scored.where(F.col("similarity") >= threshold), "spot-pairs")


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs (with doc_id, text) and next_<c> for each of `columns`: that of the next document by descending doc_id, ties
    by text, null ids last; after the last comes the first again.

    No task holds all rows: quantiles of the ids, as many as the texts ask for, deal them into buckets of like size, the
    first row of each bucket is also sent to the bucket before it, and each bucket is windowed by itself. The driver gets
    two numbers a bucket. derive: adds columns behind the shuffle, which `columns` may name."""
    held = docs.agg(F.sum(F.length("text") + 100)).first()[0] or 0
    parts = max(1, min(BUCKETS, held // BUCKET))
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts + 100)).first()[0] if parts > 1 else None
    bounds = sorted(set(found or []))
    # the place of an id among the bounds, by halving; buckets go from the largest ids to the smallest, and then nulls
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    place, step = F.lit(0), 1 << len(bounds).bit_length()
    halve = lambda k: lambda i: F.when((i + k <= len(bounds)) & (F.get(table, i + (k - 1)) <= F.col("doc_id")), i + k).otherwise(i)
    while step := step >> 1:
        place = let(place, halve(step))
    home = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(len(bounds) - place) if bounds else F.lit(0)
    firsts = {r["home"]: r["head"] for r in docs.groupBy(home.alias("home")).agg(F.max("doc_id").alias("head")).collect()}
    # buckets that no row is in are left out
    number = {b: i for i, b in enumerate(sorted(firsts))}
    heads = [firsts[b] for b in sorted(firsts)]
    n = max(1, len(heads))
    texts = lambda xs: F.split(F.lit(",".join("" if x is None else str(x) for x in xs)), ",")
    b, at, wrap = (free_name(docs, x) for x in ("n_bucket", "n_home", "n_copy"))
    rows = docs.withColumn(at, F.get(texts([number.get(i, 0) for i in range(len(bounds) + 1)]).cast("array<int>"), home) if n > 1 else F.lit(0))
    head = F.get(F.transform(texts(heads), lambda x: F.nullif(x, F.lit("")).cast("bigint")), F.col(at))
    is_head = F.col("doc_id").eqNullSafe(head) if heads else F.lit(False)
    before = F.pmod(F.col(at) - 1, F.lit(n))
    rows = rows.withColumn(b, F.explode(F.when(is_head, F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("copy")), F.struct(before.alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col(at).alias("b"), F.lit(0).alias("copy"))))))
    rows = rows.withColumn(wrap, F.col(b)["copy"]).withColumn(b, F.col(b)["b"])
    w = Window.partitionBy(b).orderBy(F.col(wrap), F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.drop(at)
    rows = derive(rows.repartition(b)) if derive else rows
    got = rows.select(*[c for c in rows.columns if c not in (b, wrap)], wrap, *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return got.where(F.col(wrap) == 0).drop(wrap)


def query(docs: DataFrame) -> DataFrame:
    """The contract of op7: fingerprints of every text and of its edited text."""
    # texts alone cross the shuffle: signatures, which are as long, are worked out behind it
    own = lambda df: with_signatures(df, "text", "sigs")
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text", "sigs"], own)
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 3)"), F.expr("left(next_text, length(text) div 3)"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
