"""Components against union-find, with hubs, chains and loops; numbering by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import connected, graphs
from skeinwork.plans.common import cut


@pytest.mark.parametrize("hubs", [5_000, 4])
def test_components(spark, monkeypatch, hubs):
    monkeypatch.setattr(connected, "HUBS", hubs)
    r = random.Random(1)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(400)] + [(7, i) for i in range(4000, 4400)] + [(5000 + i, 9000) for i in range(300)] + [(8000 + i, 8001 + i) for i in range(40)] + [(3, 3)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = connected.components(spark.createDataFrame(edges, "u long, v long"), cut).collect()
    assert len(got) == len({r["v"] for r in got})
    assert {r["v"]: r["component"] for r in got} == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_numbers(spark):
    rows = spark.createDataFrame([(x, str(x)) for x in random.Random(2).sample(range(10**6), 500)], "x long, s string").repartition(7)
    got = sorted((r["n"], r["s"]) for r in graphs.numbered(rows, ["s"], "n", cut).collect())
    assert got == list(enumerate(sorted(str(r["x"]) for r in rows.collect())))
    assert graphs.numbered(rows.where(F.col("x") < 0), ["s"], "n", cut).count() == 0
