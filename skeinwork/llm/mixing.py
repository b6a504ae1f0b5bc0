"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions throughout.

Targets: sources, ordered by code point with null last, weigh 3, 1, 2, 3, 1, 2, ...; they share `share` times all words,
and no target may pass `cap` times its source's words. The limits are met exactly by filling to one common level.

Copies: every document of a source should be taken target / source_size times on average. The whole part is certain;
the fractional parts are rounded by pivots. Two documents with fractional copies exchange words, from one to the other
or back, as far as one of them becomes integral. Which way it goes is random, with the odds that keep both expectations;
the words of the pair stay the same, so until the root a source's words are exactly its target.

Tree: documents are dealt by hash into groups of about FAN, each group is folded into decisions and one residual, the
residuals of FAN groups meet in the next level. A level is a written table of a FAN-th of the one before, so a hot source
is many groups, and a lost executor costs a group. At the root the last residual of a source meets about SPARE documents
that were kept for it. There a document's pivot is all smaller ones together, largest first: it gives words to them or
takes words from them, from each in proportion to size * p * (1 - p), until it or one of them becomes integral. The odds
again keep every expectation, whatever the documents' own p, and the words stay the same. One document a source is left,
which is drawn by its own p (column `drawn` of copies): a source's words are off by part of its size. It is a small one
unless a large document has more to give than all smaller ones can take, as happens in sources of few documents; no
rounding without bias can keep such a source's words.

Random numbers are hashes of (doc_id, size, text hash, level): reruns and retries agree. Repeated rows with the same
source, doc_id and text are one unit with a count, whose copies are dealt evenly. Null and empty texts have size 0 and are
never taken by the query. Null sources are one source, null ids are told apart by their texts, an empty table gives an
empty result, and extra columns are left alone, whatever they are called.

Texts are counted whole, however long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, let, stage, words

#: Units of a group, on average.
FAN = 32
#: Units of a source, on average, that wait for the root.
SPARE = 256
#: A p so near to 0 or 1 is taken as it: less than a word for documents of a million words.
NEAR = 1e-9
#: Sources whose targets are broadcast, at 100 bytes each.
BROADCAST_SOURCES = 50_000
WEIGHTS = (3, 1, 2)


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, units) of a table with source, size. One row per source from here on."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    src = src.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - (F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    src = src.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # sources fill up in order; the level that the rest shares is the first that its own source can take
    src = src.withColumn("shared", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("shared"), F.col("most")))
    return src.select("source", "source_size", target.alias("target"), "units")


def _chance(x: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(x["doc_id"], x["size"], x["h"], F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, level: int) -> Column:
    """Decisions (extra 0 or 1) for all but one of the items, and the residual with its probability, by pivots in random
    order. items: array of struct(rnd, doc_id, size, h, m, whole, p)."""
    kind = "array<struct<doc_id:bigint,size:bigint,h:bigint,m:bigint,whole:bigint,extra:int,p:double>>"
    say = lambda x, extra, p: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["h"].alias("h"), x["m"].alias("m"), x["whole"].alias("whole"), extra.alias("extra"), p.alias("p"))
    none, open_ = F.lit(None).cast("double"), F.lit(None).cast("int")

    def step(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        s1, p1, s2, p2 = a["size"], a["p"], x["size"], x["p"]
        give = F.least(p1 * s1, (1 - p2) * s2)  # words that may go from the carry to x
        take = F.least((1 - p1) * s1, p2 * s2)  # and back
        odds = F.struct(give.alias("give"), take.alias("take"), _chance(x, level).alias("chance"))
        gives = lambda o: F.when(o["give"] + o["take"] > 0, o["chance"] * (o["give"] + o["take"]) < o["take"]).otherwise(F.lit(True))

        def settle(g: Column) -> Column:
            # of the two, the one that becomes integral is decided and the other is carried
            first = F.when(g, p1 * s1 <= (1 - p2) * s2).otherwise((1 - p1) * s1 <= p2 * s2)
            q1 = F.when(g, p1 - (1 - p2) * s2 / s1).otherwise(p1 + p2 * s2 / s1)
            q2 = F.when(g, p2 + p1 * s1 / s2).otherwise(p2 - (1 - p1) * s1 / s2)
            inside = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
            ends = lambda f: F.struct(
                F.when(f, say(x, open_, inside(q2))).otherwise(say(a, open_, inside(q1))).alias("carry"),
                F.concat(acc["out"], F.array(F.when(f, say(a, F.when(g, 0).otherwise(1), none)).otherwise(say(x, F.when(g, 1).otherwise(0), none)))).alias("out"),
            )
            return let(first, ends)

        return let(odds, lambda o: let(gives(o), settle))

    first = say(F.get(items, 0), open_, F.get(items, 0)["p"])
    start = F.struct(first.alias("carry"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.slice(items, 2, 1 << 30), start, step, lambda acc: F.concat(acc["out"], F.array(acc["carry"])))


def _root(items: Column) -> Column:
    """Decisions for all items of a root group, largest first: each against all smaller ones together; see the module. Each
    step decides one item at least, so as many steps as items leave one, which is drawn by its own p."""
    done = "array<struct<doc_id:bigint,size:bigint,h:bigint,m:bigint,whole:bigint,extra:int,drawn:boolean>>"
    say = lambda x, extra, drawn: F.struct(*[x[c].alias(c) for c in ("doc_id", "size", "h", "m", "whole")], extra.cast("int").alias("extra"), F.lit(drawn).alias("drawn"))
    near = lambda p: F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)
    moved = lambda x, words: x.withField("p", near(x["p"] + words / x["size"]))
    share = lambda x: x["size"] * x["p"] * (1 - x["p"])
    total = lambda xs, zero, f: F.aggregate(xs, F.lit(zero), f)

    def settle(x: Column, rest: Column) -> Column:
        """x and the rest after one exchange."""
        sums = F.struct(
            total(rest, 0.0, lambda a, y: a + share(y)).alias("all"), total(rest, 0.0, lambda a, y: F.greatest(a, y["p"])).alias("high"), total(rest, 1.0, lambda a, y: F.least(a, y["p"])).alias("low")
        )
        ends = lambda t: F.struct(F.least(x["p"] * x["size"], t["all"] / t["high"]).alias("give"), F.least((1 - x["p"]) * x["size"], t["all"] / (1 - t["low"])).alias("take"), t["all"].alias("all"))
        way = lambda e: F.struct(F.when(_chance(x, 1000) * (e["give"] + e["take"]) < e["take"], e["give"]).otherwise(-e["take"]).alias("gone"), e["all"].alias("all"))
        both = lambda g: F.concat(F.array(moved(x, -g["gone"])), F.transform(rest, lambda y: moved(y, g["gone"] * share(y) / g["all"])))
        return let(sums, lambda t: let(ends(t), lambda e: let(way(e), both)))

    def step(acc: Column, _: Column) -> Column:
        open_ = acc["open"]
        after = settle(F.get(open_, 0), F.slice(open_, 2, F.greatest(F.size(open_) - 1, F.lit(0))))
        sorted_ = lambda xs: F.struct(
            F.filter(xs, lambda x: (x["p"] > 0) & (x["p"] < 1)).alias("open"),
            F.concat(acc["out"], F.transform(F.filter(xs, lambda x: (x["p"] <= 0) | (x["p"] >= 1)), lambda x: say(x, x["p"], False))).alias("out"),
        )
        return F.when(F.size(open_) > 1, let(after, sorted_)).otherwise(acc)

    start = F.struct(items.alias("open"), F.array().cast(done).alias("out"))
    last = lambda acc: F.concat(acc["out"], F.transform(acc["open"], lambda x: say(x, _chance(x, 2000) < x["p"], True)))
    return F.aggregate(F.sequence(F.lit(1), F.size(items)), start, step, last)


def copies(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, doc_id, size, h, m, source_size, target, total, drawn) from a table with doc_id, source, size and h, the hash of
    the text: the m rows of a unit get `total` copies together. drawn: the one unit of a source that no pivot decided."""
    unit = ["doc_id", "size", "h"]
    aims = stage(targets(sized, share, cap, weights).withColumnRenamed("source", "aim_source"), "mix-aims")
    if aims.count() <= BROADCAST_SOURCES:  # else it is joined like any other table
        aims = F.broadcast(aims)
    units = sized.groupBy("source", *unit).agg(F.count("*").alias("m"))
    units = units.join(aims, units["source"].eqNullSafe(F.col("aim_source")), "left").drop("aim_source")
    want = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("want", want).withColumn("whole", F.floor("want")).withColumn("p", F.col("want") - F.col("whole"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("units") / FAN))
    units = stage(units.withColumn("bucket", F.pmod(F.xxhash64(*unit), buckets)).drop("want"), "mix-units")
    most = units.agg(F.max(buckets)).first()[0] or 1
    settled = (F.col("size") == 0) | (F.col("p") == 0)
    pivot = F.lit(False).alias("drawn")
    fixed = units.where(settled).select("source", *unit, "m", "whole", F.lit(0).alias("extra"), pivot)
    spare = F.pmod(F.xxhash64(*unit, F.lit("spare")), F.greatest(F.lit(1), F.ceil(F.col("units") / SPARE))) == 0
    todo, parts = units.where(~settled & ~spare), [fixed]
    for level in range(1 + math.ceil(math.log(most, FAN)) if most > 1 else 1):
        item = F.struct(F.xxhash64(*unit, F.lit(-1 - level)).alias("rnd"), *unit, "m", "whole", "p")
        groups = todo.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded = groups.select("source", "bucket", F.explode(_fold(F.col("items"), level)).alias("d"))
        done = stage(folded.select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), "d.*"), f"mix-level{level}")
        parts.append(done.where(F.col("extra").isNotNull()).select("source", *unit, "m", "whole", "extra", pivot))
        todo = done.where(F.col("extra").isNull()).drop("extra")
    last = ["source", *unit, "m", "whole", "p"]
    root = todo.select(*last).unionByName(units.where(~settled & spare).select(*last))
    item = F.struct((-F.col("size")).alias("by"), F.xxhash64(*unit, F.lit("root")).alias("rnd"), *unit, "m", "whole", "p")
    rooted = root.groupBy("source").agg(F.sort_array(F.collect_list(item)).alias("items")).select("source", F.explode(_root(F.col("items"))).alias("d"))
    parts.append(rooted.select("source", "d.*"))
    decided = parts[0]
    for x in parts[1:]:
        decided = decided.unionByName(x)
    got = decided.join(aims.drop("units"), decided["source"].eqNullSafe(F.col("aim_source")), "left")
    return got.select("source", *unit, "m", "source_size", "target", (F.col("whole") + F.col("extra")).alias("total"), "drawn")


def _share(total: Column, m: Column, k: Column) -> Column:
    """Copies of the k-th of m equal rows, from 1."""
    return F.floor(total / m) + F.when(k <= total % m, 1).otherwise(0)


def _size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def query(docs: DataFrame) -> DataFrame:
    """The contract of op5: one row per document."""
    sized = stage(docs.select(F.col("doc_id").cast("long"), "source", _size(F.col("text")).alias("size"), F.xxhash64("text").alias("h")), "mix-sizes")
    got = copies(sized).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    n = _share(F.col("total"), F.col("m"), F.col("k"))
    return got.select("doc_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, or left out; the columns of docs, in any order of rows.
    Empty texts weigh nothing, so no mix is without them: they stay, once. Of equal rows that can't be dealt evenly, the
    first by their other columns are taken once more."""
    size, h, key, k, total, m = free_names(docs, "mix_size", "mix_h", "mix_key", "mix_k", "mix_total", "mix_m")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.withColumns({size: _size(F.col("text")), h: F.xxhash64("text")})
    sized = stage(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(size).alias("size"), F.col(h).alias("h")), "mix-sizes")
    decided = copies(sized, share, cap, weights)
    # a row meets its unit by one hash of all that makes a unit, and the unit must then agree; with the hash as the only
    # key of the join, its turn among equal rows is found where it is
    rows = rows.withColumn(key, F.xxhash64("source", F.col("doc_id").cast("long"), size, h))
    names = dict(zip(("source", "doc_id", "size", "h", "total", "m", "key"), free_names(rows, "u_source", "u_doc_id", "u_size", "u_h", total, m, "u_key")))
    d = decided.select(F.xxhash64("source", "doc_id", "size", "h").alias(names["key"]), *[F.col(c).alias(n) for c, n in names.items() if c != "key"])
    same = rows["doc_id"].cast("long").eqNullSafe(d[names["doc_id"]]) & rows["source"].eqNullSafe(d[names["source"]]) & (rows[size] == d[names["size"]]) & (rows[h] == d[names["h"]])
    got = rows.join(d, (rows[key] == d[names["key"]]) & F.when(same, True).otherwise(False))
    turn = Window.partitionBy(key, names["source"], names["doc_id"], names["size"], names["h"]).orderBy(F.xxhash64(*plain))
    got = got.withColumn(k, F.row_number().over(turn))
    n = F.when(F.col(size) == 0, 1).otherwise(_share(F.col(names["total"]), F.col(names["m"]), F.col(k))).cast("int")
    return got.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), n)).alias(k)).drop(k)
