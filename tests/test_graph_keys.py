"""Keys of multigraphs whose edges are mostly parallel, against lists spelled out."""

import hashlib
import random

from pyspark.sql import functions as F

from skeinwork.operators import graphs
from skeinwork.plans.common import cut


def spelled(pairs, ids):
    return ",".join(f"{a}-{b}" for a, b in sorted(tuple(sorted((ids[u], ids[v]))) for u, v in pairs))


def by_degree(pairs):
    near = {}
    for u, v in pairs:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    sign = {v: (len(w), sum(u == v == x for u, x in pairs), sorted(len(near[x]) for x in w), v) for v, w in near.items()}
    return {v: i for i, v in enumerate(sorted(sign, key=sign.get))}


def test_keys_of_small_multigraphs(spark):
    r = random.Random(2)
    for n, m in ((1, 3), (4, 30), (12, 20), (9, 80)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        e = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "eid long, u long, v long")
        used = sorted({x for p in pairs for x in p}, key=str)
        assert tuple(graphs.label_key(e, cut).first()) == (len(used), spelled(pairs, {v: i for i, v in enumerate(used)}))
        ids = by_degree(pairs)
        assert tuple(graphs.canonical_key(e, cut).first()) == (len(ids), hashlib.sha256(f"{len(ids)}|{spelled(pairs, ids)}".encode()).hexdigest())


def test_no_value_grows_with_parallel_edges(spark):
    """A million edges between two vertices are a row of the list that is hashed, not a text of its own."""
    e = spark.range(1_000_000).select(F.col("id").alias("eid"), F.lit(1).cast("bigint").alias("u"), F.lit(2).cast("bigint").alias("v"))
    got = graphs.canonical_key(e, cut)
    assert got.first()["canonical_key"] == hashlib.sha256(("2|" + ",".join(["0-1"] * 1_000_000)).encode()).hexdigest()
    ids = spark.createDataFrame([(1, 0), (2, 1)], "x long, id long")
    assert [tuple(x) for x in graphs._runs(e, ids).collect()] == [(0, 1, 1_000_000)]
    assert "collect_list(struct(a" not in got._jdf.queryExecution().optimizedPlan().toString()
