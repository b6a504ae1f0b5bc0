"""Thinning by blocks and tracing by pointers against the same work on whole masks."""

import tempfile
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import fields, skeleton, thinning
from skeinwork.plans import skeleton_plans
from skeinwork.plans.common import cut

KIND = "grid_id long, ix long, iy long, iz long"


def table(spark, grids):
    return spark.createDataFrame([(g, *map(int, v)) for g, vs in grids.items() for v in vs], KIND)


def blobs(r, n, holes):
    """Balls and bars that overlap, with some voxels taken out."""
    full = np.zeros((n, n, n), bool)
    grid = np.indices(full.shape)
    for _ in range(5):
        c, s = r.integers(4, n - 4, 3), r.uniform(2, 4.5)
        full |= ((grid - c[:, None, None, None]) ** 2).sum(0) < s * s
    for _ in range(3):
        a = int(r.integers(0, 3))
        at = [slice(int(x), int(x) + 3) for x in r.integers(2, n - 4, 3)]
        at[a] = slice(1, n - 1)
        full[tuple(at)] = True
    full &= r.random(full.shape) > holes
    return [tuple(v) for v in np.argwhere(full).tolist()]


def whole(voxels):
    """The same peeling on one volume."""
    full = np.zeros(np.array(max(np.array(voxels).tolist() and [np.array(voxels).max(0).tolist()])) + 3, bool)
    at = np.array(voxels) + 1
    full[at[:, 0], at[:, 1], at[:, 2]] = True
    before = -1
    while before != full.sum():
        before = full.sum()
        thinning.peel(full, (-1, -1, -1))
    return {tuple(v) for v in (np.argwhere(full) - 1).tolist()}


def parts(voxels):
    return skeleton._groups(set(voxels), skeleton._touch)


def euler(spark, voxels):
    return fields.euler(table(spark, {0: voxels}).select("ix", "iy", "iz")).first()["euler"]


def test_blocks_are_the_whole(spark):
    r = np.random.default_rng(1)
    grids = {g: blobs(r, 26, h) for g, h in enumerate((0.0, 0.02, 0.0))}
    got = thinning.thin(table(spark, grids), cut, block=10, iterations=1).collect()
    for g, voxels in grids.items():
        left = [(x["ix"], x["iy"], x["iz"]) for x in got if x["grid_id"] == g]
        assert len(left) == len(set(left)) and set(left) == whole(voxels) <= set(voxels) and len(left) < len(voxels) / 4
        assert parts(left) == parts(voxels) and euler(spark, left) == euler(spark, voxels)
    again = thinning.thin(spark.createDataFrame(got, KIND), cut, block=16, iterations=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_iterations_between_exchanges_change_nothing(spark):
    voxels = blobs(np.random.default_rng(4), 30, 0.0)
    a, b = (sorted(map(tuple, thinning.thin(table(spark, {3: voxels}), cut, block=k, iterations=i).collect())) for k, i in ((12, 2), (64, 1)))
    assert a == b


def test_no_voxels_and_single_ones(spark):
    assert thinning.thin(spark.createDataFrame([], KIND), cut).count() == 0
    assert [tuple(r) for r in thinning.thin(table(spark, {7: [(0, 0, 0), (0, 0, 0), (65535, 5, 5)]}), cut).orderBy("ix").collect()] == [(7, 0, 0, 0), (7, 65535, 5, 5)]


def by_hand(voxels):
    places, edges = skeleton.trace(set(voxels))
    return sorted(map(lambda p: tuple(map(float, p)), places)), sorted((tuple(map(float, places[u])), tuple(map(float, places[v])), [tuple(p) for p in path]) for u, v, path in edges)


def by_pointers(spark, grids):
    nodes, points = thinning.trace(table(spark, grids), cut)
    at = {r["node"]: (r["grid_id"], (r["x"], r["y"], r["z"])) for r in nodes.collect()}
    paths = {}
    for r in points.collect():
        paths.setdefault((tuple(r["edge"]), r["u"], r["v"]), []).append((r["seq"], (r["x"], r["y"], r["z"])))
    out = {g: ([], []) for g in grids}
    for g, p in at.values():
        out[g][0].append(p)
    for (_, u, v), ps in paths.items():
        ps.sort()
        assert [s for s, _ in ps] == list(range(len(ps)))
        out[at[u][0]][1].append((at[u][1], at[v][1], [p for _, p in ps]))
    return {g: (sorted(a), sorted(b)) for g, (a, b) in out.items()}


def test_traces_are_the_ones_by_hand(spark):
    """100 masks: random specks, thinned blobs, rings, crosses and a long line."""
    r = np.random.default_rng(6)
    grids = {g: [tuple(v) for v in np.unique(r.integers(0, 7, (int(r.integers(1, 45)), 3)), axis=0).tolist()] for g in range(85)}
    grids |= {g: sorted(whole(blobs(r, 22, 0.01))) for g in range(85, 95)}
    ring = [(0, k, 0) for k in range(9)] + [(8, k, 0) for k in range(9)] + [(k, 0, 0) for k in range(1, 8)] + [(k, 8, 0) for k in range(1, 8)]
    grids |= {95: ring, 96: ring + [(4, 8, k) for k in range(1, 6)], 97: [(k, 3, 3) for k in range(700)], 98: [(5, 5, 5)], 99: [(k, 5, 5) for k in range(11)] + [(5, k, 5) for k in range(11)]}
    got = by_pointers(spark, grids)
    for g, voxels in grids.items():
        assert got[g] == by_hand(voxels), g


def test_euler_of_many_grids(spark):
    ball, ring = [(1, 1, 1), (1, 1, 2), (2, 1, 1)], [(a, b, 0) for a in range(3) for b in range(3) if (a, b) != (1, 1)]
    shell = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if (a, b, c) != (1, 1, 1)]
    got = {r["grid_id"]: r["euler"] for r in thinning.euler(table(spark, {0: ball, 1: ring, 2: shell})).collect()}
    assert got == {0: 1, 1: 0, 2: 2}


def test_simple_voxels_all_at_once():
    """Half a million neighbourhoods, most of them different, within seconds; a part of them against skeleton._simple."""
    r = np.random.default_rng(1)
    patterns = np.concatenate([sum((r.random(70_000) < q).astype(np.int64) << k for k in range(26)) for q in (0.08, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)] + [np.array([0, 1, 3, (1 << 26) - 1])])
    began = time.process_time()
    got = thinning._goes(patterns)
    assert time.process_time() - began < 5  # one after another they take three times as long
    part = np.concatenate([np.arange(0, len(patterns), 97), np.arange(len(patterns) - 4, len(patterns))])
    for p, goes in zip(patterns[part].tolist(), got[part].tolist()):
        assert goes == (bin(p).count("1") > 1 and skeleton._simple(frozenset(o for k, o in enumerate(skeleton._NEAR) if p >> k & 1)))
    assert 0 < got.sum() < len(got)


def test_pieces_of_tubes_go_to_all_tasks(spark, sf):
    """A table in one file, with few labels, still has its voxels made by all tasks."""
    made = skeleton_plans.tubes(spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and all(f"], {tasks}" in line for line in dealt), plan
    assert made.count() == made.distinct().count()
