"""Chains and simplified graphs against contraction one vertex at a time, and what they do with vertices of very many edges."""

import random

from pyspark.sql import functions as F

from skeinwork.operators import graphs
from skeinwork.plans import graph_plans
from skeinwork.plans.common import cut


def brute(edges):
    """(u, v, edges) of all chains."""
    left, loose = [(u, v, 1) for _, u, v in edges], True
    while loose:
        loose = False
        for x in {x for e in left for x in e[:2]}:
            at = [e for e in left if x in e[:2]]
            if len(at) == 2 and all(e[0] != e[1] for e in at):
                a, b = (e[0] if e[1] == x else e[1] for e in at)
                for e in at:
                    left.remove(e)
                left.append((a, b, at[0][2] + at[1][2]))
                loose = True
    return sorted((*sorted(e[:2]), e[2]) for e in left)


def test_chains(spark):
    r = random.Random(8)
    kinds = [[(r.randrange(40), r.randrange(40)) for _ in range(38)] for _ in range(2)]
    kinds += [[(i, i + 1) for i in range(9)] + [(3, 20), (20, 3), (30, 30)]]
    for pairs in kinds:
        edges = [(7 * i, *p) for i, p in enumerate(pairs)]
        got = graphs.chains(spark.createDataFrame(edges, "eid long, u long, v long"), cut).collect()
        want = brute(edges)
        # a ring is put on its least vertex; brute may end on any
        assert sorted(x["edges"] for x in got) == sorted(e[2] for e in want)
        assert sorted((x["u"], x["v"], x["edges"]) for x in got if x["u"] != x["v"]) == [e for e in want if e[0] != e[1]]


def test_ring_and_tree(spark):
    ring = spark.createDataFrame([(5, 3, 4), (6, 4, 9), (7, 9, 3)], "eid long, u long, v long")
    assert [tuple(x) for x in graphs.chains(ring, cut).collect()] == [(5, 3, 3, 3)]
    assert [tuple(x) for x in graphs.simplify(ring, cut).collect()] == [(0, 0, 3)]
    tree = spark.createDataFrame([(1, 0, 1), (2, 1, 2), (3, 2, 5), (4, 2, 6)], "eid long, u long, v long")
    assert graphs.simplify(tree, cut).count() == 0


def test_edges_of_a_hub_do_not_meet_by_it(spark, monkeypatch):
    """No join of the edges is by a vertex, so that a vertex with most of them doesn't put them into one task; components are
    looked for in runs and in what contraction leaves, never in all vertices."""
    seen = []
    real = graphs.components

    def components(pairs, cut):
        seen.append(pairs.count())
        return real(pairs, cut)

    monkeypatch.setattr(graphs, "components", components)
    n = 300
    e = spark.range(2 * n).select(F.col("id").alias("eid"), (F.col("id") % 2).alias("u"), (10 + F.floor(F.col("id") / 2)).alias("v"))
    got = graphs.simplify(e, cut)
    assert [tuple(x) for x in got.groupBy("u", "v", "edges").count().collect()] == [(0, 1, 2, n)]
    assert seen == [n, n]  # the pairs of edges, and the contracted edges; the graph has 2 n edges
    plan = graphs.chains(e, cut)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_trade_edges_are_made_by_all_tasks(spark, sf, monkeypatch):
    """The few pairs of nations fit into one task, the edges that they stand for don't: runs of them are dealt out, and ids are
    the same whatever the length of a run."""
    told = lambda df: sorted(tuple(x) for x in df.collect())
    long_ = told(graph_plans.whole(spark, sf))
    monkeypatch.setattr(graph_plans, "RUN", 3)
    edges = graph_plans.whole(spark, sf)
    n = graph_plans.trade(spark, sf).groupBy("u", "v").count().collect()
    assert told(edges) == long_ == sorted(((r["u"] * 1000 + r["v"]) * 10**12 + k, r["u"], r["v"]) for r in n for k in range(r["count"]))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert edges.select(F.spark_partition_id()).distinct().count() == tasks > 1
