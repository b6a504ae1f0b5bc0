"""Multigraphs as edge tables (eid, u, v): summaries, pruning, contraction and keys."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .connected import components

Cut = Callable[[DataFrame], DataFrame]


def numbered(rows: DataFrame, order: list[str], name: str, cut: Cut) -> DataFrame:
    """rows with their place in an order, from 0, without a task that holds them all: they are sorted by ranges and
    written, each range counts its own, and the driver gets one number a range."""
    place, part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), F.spark_partition_id()
    by_range = cut(rows.orderBy(*order).select("*", place.alias("_place"), part.alias("_part")))
    upto, before = 0, [F.lit(-1), F.lit(0).cast("bigint")]
    for r in sorted(by_range.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before += [F.lit(r["_part"]), F.lit(upto).cast("bigint")]
        upto += r["n"]
    return by_range.select(*rows.columns, (F.col("_place") + F.create_map(*before)[F.col("_part")]).alias(name))


def ends(edges: DataFrame) -> DataFrame:
    """(eid, v, w): each edge from both of its ends; a loop comes twice."""
    e = edges.select("eid", "u", "v")
    return e.select("eid", F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("w")), F.struct(F.col("v").alias("v"), F.col("u").alias("w")))).alias("x")).select("eid", "x.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(v, degree): loops count twice."""
    return ends(edges).groupBy("v").agg(F.count("*").alias("degree"))


def canonical(edges: DataFrame) -> DataFrame:
    """(u, v, k): smaller end first, k numbers parallel edges from 0."""
    e = edges.select("eid", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return e.select("u", "v", (F.row_number().over(Window.partitionBy("u", "v").orderBy("eid")) - 1).alias("k"))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u < v."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, loops, max_multiplicity. Multiplicities are pre-aggregated, so that is all that's shuffled."""
    pairs = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("x")).distinct().agg(F.count("*").alias("nodes"))
    sums = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("n")).otherwise(0)), F.lit(0)).alias("loops"), F.coalesce(F.max("n"), F.lit(0)).alias("max_multiplicity"))
    return nodes.join(sums)


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(degree, nodes), without empty bins."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def connected(edges: DataFrame, cut: Cut) -> DataFrame:
    """(v, component) of every end of an edge; vertices with loops only are components of their own."""
    all_v = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    found = components(edges.select("u", "v"), cut)
    return all_v.join(found, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def cycle_rank(edges: DataFrame, cut: Cut) -> DataFrame:
    """One row: vertices, edges, components, rank = E - V + C, has_cycle."""
    c = connected(edges, cut).agg(F.count("*").alias("vertices"), F.countDistinct("component").alias("components"))
    e = edges.agg(F.count("*").alias("edges"))
    return c.join(e).withColumn("rank", F.col("edges") - F.col("vertices") + F.col("components")).withColumn("has_cycle", F.col("rank") > 0)


def is_trivalent(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg((F.coalesce(F.max("degree"), F.lit(0)) <= 3).alias("is_trivalent"))


def prune_leaves(edges: DataFrame, cut: Cut) -> DataFrame:
    """edges without those that lead to leaves, again and again until there are none. A tree loses all its edges; its
    remaining vertex is that of least id, see simplify."""
    while True:
        leaves = degrees(edges).where("degree = 1").select(F.col("v").alias("leaf"))
        left = edges.join(leaves, F.col("u") == F.col("leaf"), "left_anti").join(leaves, F.col("v") == F.col("leaf"), "left_anti")
        left = cut(left)
        if left.count() == edges.count():
            return left
        edges = left


def chains(edges: DataFrame, cut: Cut) -> DataFrame:
    """(chain, u, v, edges): each maximal run of edges over vertices of degree two as one edge. A ring without a junction is
    a loop on its least vertex. Runs are the components of the edges themselves, linked where a vertex has just two. Edges
    meet by their ids and never by a vertex, which may have most of them."""
    met = cut(ends(edges).groupBy("v").agg(F.count("*").alias("degree"), F.min("eid").alias("u"), F.max("eid").alias("w")).where("degree = 2").select("v", "u", "w"))
    runs = components(met.where("u <> w").select("u", F.col("w").alias("v")), cut)
    passed = met.select(F.explode(F.array("u", "w")).alias("eid"), "v").groupBy("eid").agg(F.min("v").alias("p"), F.max("v").alias("q"))
    named = edges.select("eid", "u", "v").join(passed, "eid", "left").join(runs.select(F.col("v").alias("eid"), F.col("component").alias("chain")), "eid", "left")
    # the ends of an edge that are tips of its chain
    u, v = (F.when(F.coalesce((F.col(c) == F.col("p")) | (F.col(c) == F.col("q")), F.lit(False)), F.lit(None)).otherwise(F.col(c)) for c in "uv")
    rows = named.select(F.coalesce("chain", "eid").alias("chain"), F.least("u", "v").alias("low"), F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    size = rows.groupBy("chain").agg(F.count("*").alias("edges"), F.min("low").alias("low"), F.min("a").alias("a"), F.max("b").alias("b"))
    return size.select("chain", F.coalesce("a", "low").alias("u"), F.coalesce("b", "low").alias("v"), "edges")


def simplify(edges: DataFrame, cut: Cut) -> DataFrame:
    """(u, v, edges) of the contracted chains with vertices numbered from 0 by id. An acyclic graph has no edges left.
    Contraction keeps the cycle rank, so cycles are looked for in what it leaves."""
    got = cut(chains(edges, cut))
    if not cycle_rank(got, cut).first()["has_cycle"]:
        return got.limit(0).select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), "edges")
    ids = numbered(got.select(F.explode(F.array("u", "v")).alias("x")).distinct(), ["x"], "id", cut)
    a, b = ids.select(F.col("x").alias("u"), F.col("id").alias("a")), ids.select(F.col("x").alias("v"), F.col("id").alias("b"))
    return got.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "edges")


def distances(edges: DataFrame, cut: Cut) -> DataFrame:
    """(src, dst, d) of all pairs that are connected, by breadth-first frontiers; meant for contracted graphs."""
    near = cut(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    seen = cut(near.select(F.col("u").alias("src"), F.col("u").alias("dst"), F.lit(0).alias("d")).distinct())
    step, front = 0, seen
    while front.limit(1).count():
        step += 1
        new = front.join(near, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst"), F.lit(step).alias("d")).distinct()
        front = cut(new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def diameter(edges: DataFrame, cut: Cut) -> DataFrame:
    """One row: is_connected, diameter, average_path over ordered pairs; null unless connected."""
    d = distances(edges, cut)
    n = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().agg(F.count("*").alias("n"))
    got = d.agg(F.max("d").alias("far"), F.sum("d").alias("total"), F.count("*").alias("pairs")).join(n)
    whole = F.col("pairs") == F.col("n") * F.col("n")
    return got.select(whole.alias("is_connected"), F.when(whole, F.col("far").cast("bigint")).alias("diameter"), F.when(whole, F.col("total") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("average_path"))


def wl_hash(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(v, label): labels of the simple graph after `rounds` of neighbourhood hashing; equal label multisets make equal
    hashes, see wl_key."""
    near = simple(edges)
    near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = near.groupBy(F.col("u").alias("v")).agg(F.count("*").cast("string").alias("label"))
    for _ in range(rounds):
        told = near.join(labels, "v").groupBy("u").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("around")).withColumnRenamed("u", "v")
        labels = labels.join(told, "v").select("v", F.md5(F.concat_ws("|", "label", "around").cast("binary")).alias("label"))
    return labels


def wl_key(labels: DataFrame) -> DataFrame:
    """One row: hash over the sorted label counts."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "label", "n"))), ";").cast("binary")).alias("wl_hash"))


def label_key(edges: DataFrame, cut: Cut) -> DataFrame:
    """One row: n and the sorted edge list after numbering labels by their text. The list is one value, so 2 GB of text are
    the most that it can have; until the last step parallel edges are a pair and their number."""
    ids = numbered(edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("said", F.col("x").cast("string")), ["said"], "id", cut)
    n = ids.count()
    runs = F.array_sort(F.collect_list(F.struct("a", "b", "n")))
    text = F.array_join(F.transform(runs, lambda x: F.concat(F.repeat(F.concat(_told(x["a"], x["b"]), F.lit(",")), (x["n"] - 1).cast("int")), _told(x["a"], x["b"]))), ",")
    return _runs(edges, ids).agg(text.alias("edge_list")).select(F.lit(n).cast("bigint").alias("n"), "edge_list")


def _told(a: Column, b: Column) -> Column:
    return F.concat_ws("-", a, b)


def _runs(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, n): the pairs of numbers of edges' ends, smaller first, and how many edges have them."""
    once = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    a, b = ids.select(F.col("x").alias("u"), F.col("id").alias("a")), ids.select(F.col("x").alias("v"), F.col("id").alias("b"))
    return once.join(a, "u").join(b, "v").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))


def canonical_key(edges: DataFrame, cut: Cut) -> DataFrame:
    """One row: n and the sha256 of the edge list after numbering vertices by degree, loops, neighbours' degrees and id. The
    list is hashed as it comes, in its order, and never one value."""
    deg = degrees(edges)
    loops = edges.where("u = v").groupBy(F.col("u").alias("v")).agg(F.count("*").alias("loops"))
    # neighbours' degrees by runs: among as many neighbours, more of a lesser degree come first
    near = ends(edges.groupBy("u", "v").agg(F.count("*").alias("eid"))).withColumnRenamed("eid", "m")
    runs = near.join(deg.withColumnRenamed("v", "w").withColumnRenamed("degree", "other"), "w").groupBy("v", "other").agg(F.sum("m").alias("m"))
    pad = lambda c: F.lpad(c.cast("string"), 19, "0")
    around = runs.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "m"))), lambda x: F.concat(pad(x["other"]), F.lit("x"), pad(F.lit(10**18) - x["m"]))), ",").alias("around"))
    sign = deg.join(loops, "v", "left").join(around, "v").select(F.col("v").alias("x"), "degree", F.coalesce("loops", F.lit(0)).alias("loops"), "around")
    ids = numbered(sign, ["degree", "loops", "around", "x"], "id", cut)
    n = ids.count()

    def run(batches):
        told, first = hashlib.sha256(f"{n}|".encode()), True
        for rows in batches:
            for a, b, m in zip(rows["a"].tolist(), rows["b"].tolist(), rows["n"].tolist()):
                one, at = f"{a}-{b}", 0
                if first:
                    told.update(one.encode())
                    first, at = False, 1
                more = ("," + one).encode()
                while at < m:
                    told.update(more * min(m - at, 65536))
                    at += min(m - at, 65536)
        yield pd.DataFrame({"n": [n], "canonical_key": [told.hexdigest()]})

    # a hash takes its text in order, so one task reads the sorted pairs as a stream
    return _runs(edges, ids).repartition(1).sortWithinPartitions("a", "b").mapInPandas(run, "n long, canonical_key string")


def pick_edge(edges: DataFrame) -> DataFrame:
    """The first edge that is no loop."""
    return edges.where("u <> v").agg(F.min(F.struct("eid", "u", "v")).alias("e")).where("e IS NOT NULL").select("e.*")


def delete(edges: DataFrame, eid: int) -> DataFrame:
    return edges.where(F.col("eid") != eid)


def contract(edges: DataFrame, eid: int) -> DataFrame:
    """edges with the ends of one of them made its smaller end; parallels become loops. A loop can't be contracted."""
    e = edges.where(F.col("eid") == eid).first()
    if e is None or e["u"] == e["v"]:
        raise ValueError(f"edge {eid} is a loop or isn't there")
    keep, gone = min(e["u"], e["v"]), max(e["u"], e["v"])
    moved = lambda c: F.when(F.col(c) == gone, keep).otherwise(F.col(c)).alias(c)
    return edges.where(F.col("eid") != eid).select("eid", moved("u"), moved("v"))


def shortest(edges: DataFrame, positions: DataFrame, limit: float) -> DataFrame:
    """One row: the shortest edge between distinct vertices under `limit`, and which end stays (that of higher degree; of
    equal ones that with the smaller text)."""
    at = positions.select("v", "x", "y", "z")
    a, b = at.toDF("u", "x1", "y1", "z1"), at.toDF("v", "x2", "y2", "z2")
    far = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 + (F.col("z1") - F.col("z2")) ** 2)
    deg = degrees(edges)
    du, dv = deg.toDF("u", "du"), deg.toDF("v", "dv")
    rows = edges.where("u <> v").join(a, "u").join(b, "v").join(du, "u").join(dv, "v").withColumn("length", far).where(F.col("length") < limit)
    first = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u").cast("string") <= F.col("v").cast("string")))
    best = rows.agg(F.min(F.struct("length", "eid", "u", "v", F.when(first, F.col("u")).otherwise(F.col("v")).alias("keep"))).alias("e"))
    return best.where("e IS NOT NULL").select("e.*")


def tag(u: Column, v: Column) -> Column:
    return F.concat_ws("-", F.least(u, v), F.greatest(u, v))
