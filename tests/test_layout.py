"""Layouts, energies and drawn ends against differences and invariants; minors, prerequisites and streams by small cases."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import kernels, layout, models, skeleton
from skeinwork.plans import invariant_plans
from skeinwork.streaming import consensus


def test_relax_keeps_guards():
    r = np.random.default_rng(3)
    for _ in range(20):
        p = r.random((9, 2))
        a, b = np.array([0, 0, 0, 1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5, 6, 7, 8])
        q, n, status = layout.relax(p, a, b, np.full(8, 0.4), 0.01, 0.1, 0.5, 200, 1e-6, 1e-6)
        assert not (layout.crossed(q, a, b) & ~layout.crossed(p, a, b)).any() and layout.orders(q, a, b) == layout.orders(p, a, b)
        assert status in ("settled", "stuck", "steps") and n <= 200


def test_relax_settles_on_rest_length():
    q, _, status = layout.relax(np.array([[0.0, 0], [3, 0]]), np.array([0]), np.array([1]), np.array([1.0]), 0.0, 0.1, 1.0, 5000, 1e-9, 1e-9)
    assert status == "settled" and math.dist(*q) == pytest.approx(1, abs=1e-3)


def test_one_step_is_the_columns_step(spark):
    from skeinwork.operators import curves as cv

    r = np.random.default_rng(1)
    p = [(g, 10 * g + i, *map(float, r.random(2))) for g in range(3) for i in range(6)]
    s = [(g, 10 * g + i, 10 * g + i + 1, 0.3) for g in range(3) for i in range(5)]
    particles, springs = spark.createDataFrame(p, "g long, pid long, x double, y double"), spark.createDataFrame(s, "g long, a long, b long, rest double")
    one = {x["pid"]: (x["x"], x["y"]) for x in cv.relax_step(particles, springs.drop("g"), 1e-4, 0.01, 1e-3).collect()}
    two = {x["pid"]: (x["x"], x["y"]) for x in layout.layout(particles, springs, 1e-4, 0.01, 1e-3, steps=1).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)


def test_energy_gradients():
    r = np.random.default_rng(2)
    p = r.random((7, 3))
    rest = np.full(6, 0.5)
    for f in (skeleton.tangent_point, lambda x: skeleton.strain(x, rest, 1.0, 0.05)):
        e, g = f(p)
        for i in range(7):
            for k in range(3):
                step = np.zeros_like(p)
                step[i, k] = 1e-6
                assert (f(p + step)[0] - f(p - step)[0]) / 2e-6 == pytest.approx(g[i, k], rel=1e-4, abs=1e-5)


def test_drawn_ends():
    line = [(float(i), 0.0, 0.0) for i in range(30)]
    out = skeleton.drawn_to(line, np.array([29.0, 3.0, 0.0]), last=10)
    assert out[:20] == line[:20] and out[-1] == (29.0, 3.0, 0.0) and len(out) == 30
    steps = np.diff(np.array(out), axis=0)
    turn = [float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for a, b in zip(steps, steps[1:])]
    assert min(turn) > 0.9  # no kink, where a moved point alone would make one
    assert skeleton.drawn_to(line[:2], np.zeros(3)) == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def brute_minor(n, edges, host, size):
    """By all ways to give every vertex of the graph to one of the host's, or to none."""
    from itertools import product

    for at in product(range(size + 1), repeat=n):
        parts = [[v for v in range(n) if at[v] == k] for k in range(size)]
        if not all(parts):
            continue

        def whole(part):
            seen, todo = {part[0]}, [part[0]]
            while todo:
                x = todo.pop()
                for y in part:
                    if y not in seen and frozenset((x, y)) in edges:
                        seen.add(y)
                        todo.append(y)
            return len(seen) == len(part)

        if all(map(whole, parts)) and all(any(frozenset((x, y)) in edges for x in parts[a] for y in parts[b]) for a, b in host):
            return True
    return False


def test_minors_of_any_host():
    r = np.random.default_rng(5)
    hosts = {"path": [(0, 1), (1, 2)], "square": [(0, 1), (1, 2), (2, 3), (0, 3)], "claw": [(0, 1), (0, 2), (0, 3)], "k4": list(combinations(range(4), 2))}
    for _ in range(25):
        n = int(r.integers(3, 7))
        edges = {frozenset(e) for e in combinations(range(n), 2) if r.random() < 0.5}
        for host in hosts.values():
            size = 1 + max(map(max, host))
            assert kernels.has_minor(n, edges, host, size) == brute_minor(n, edges, host, size)


#: A complete graph of four vertices: four arcs across.
WIDE = "V[0,1,2];V[0,3,4];V[1,4,5];V[2,5,3]"


def test_status_and_branches(spark):
    codes = spark.createDataFrame([(1, 0, "V[0,1,2];V[2,1,0]"), (2, 0, "V[0,0,1,1]"), (3, 1, WIDE), (4, 0, "V[0,1]"), (1 + 10**9, 0, "V[0,1,2];V[2,1,0]")], "g long, n_crossings long, pd_code string")
    tried = invariant_plans.tries(codes, widest=3)
    assert {r["curve"]: r["status"] for r in invariant_plans.first_valid(tried).collect()} == {1: "ok", 2: "ok", 3: "too_wide", 4: "invalid"}
    assert {r["g"]: (r["status"], r["found_at"]) for r in invariant_plans.polynomial(tried).collect()} == {1: ("agreed", 2), 2: ("single_view", 1), 3: ("no_agreement", -1), 4: ("no_agreement", -1)}
    assert invariant_plans.tries(codes).where("curve = 3").first()["status"] == "ok"


def test_prerequisites(spark):
    grid = spark.range(5).select((F.col("id") * 0.3).alias("kx"))
    from skeinwork.functions.cplx import Z

    k, nil = F.col("kx"), F.lit(0.0)
    cases = [((Z(F.sin(k), nil), Z(nil, F.lit(0.5)), Z(k, nil)), (True, 0.5, 1, 0, 2)), ((Z(nil, F.lit(-1.0)), Z(k, nil), Z(F.cos(k), nil)), (False, None, None, None, None)), ((Z(nil, k), Z(k, nil), Z(k, nil)), (False, None, None, None, None)), ((Z(k, nil), Z(k, nil), Z(k, nil)), (False, None, None, None, None))]
    for d, want in cases[:1] + cases[2:]:
        assert tuple(models.berry_prerequisites(models.on_grid(grid, d)).first()) == want


def test_late_events_are_dropped(spark, tmp_path):
    """Behind the watermark a window is closed: a row that comes an hour late isn't counted. The watermark of a batch holds
    from the second batch after it on."""
    kind = "ts timestamp, event_type string"
    batches = [["2024-01-01 00:10", "2024-01-01 00:20"], ["2024-01-01 02:00"], ["2024-01-01 02:05"], ["2024-01-01 00:30", "2024-01-01 02:10"], ["2024-01-01 05:00"], ["2024-01-01 05:01"]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(t, "a") for t in rows], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = consensus.windows(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["start"])[11:16]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["00:00"] == 2 and got["02:00"] == 3


def test_energy_memory_is_bounded():
    """3,000 pieces make 9 million pairs, 72 MB for each number of a pair: blocks take less for all of them together."""
    import tracemalloc

    from skeinwork.operators import skeleton

    p = np.random.default_rng(4).random((3001, 3))
    tracemalloc.start()
    e, g = skeleton.tangent_point(p)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 72e6 and np.isfinite(g).all()
    few, plain = p[:60], skeleton.PAIRS
    whole = skeleton.tangent_point(few)
    try:
        skeleton.PAIRS = 100
        parts = skeleton.tangent_point(few)
    finally:
        skeleton.PAIRS = plain
    assert np.isclose(whole[0], parts[0], rtol=1e-12) and np.allclose(whole[1], parts[1], rtol=1e-9)
