"""Thinning and tracing of voxel masks of any size as Spark jobs: no task holds a grid, or a curve.

Thinning: in an iteration, voxels with an empty face neighbour are the border, and the eight subfields, by the parities of
the coordinates, are gone through in turn: the border voxels of a subfield that are simple and no ends of curves go at once.
Two voxels of a subfield never touch, so that is the same as one after another, and topology is kept. Whether a voxel goes
depends on voxels that are EIGHT steps away at most, so a block of the grid with a margin of EIGHT voxels an iteration is
worked out by itself, exactly; blocks swap margins by a shuffle after every ITERATIONS, until nothing changes. Blocks that
didn't change, nor any block around them, are left as they are.

Tracing: voxels with other than two neighbours are nodes (those that branch and touch are one), and chains of the others are
edges. Every step from a voxel to the next along a chain knows the step before it; pointers to these are doubled until they
reach a node, which takes as many joins as the logarithm of the longest chain, and their lengths are the places of the
points on the curve. Rings without a node are cut at their least voxel.

Coordinates are from 0 to 65,535, grid ids from 0 to 32,767.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .connected import components
from .skeleton import _EDGE18, _FACE, _NEAR, _share_face, _touch

Cut = Callable[[DataFrame], DataFrame]
#: Steps that an iteration can carry news, iterations between two exchanges, and voxels of a block along an axis.
EIGHT, ITERATIONS, BLOCK = 8, 2, 48
_SUBFIELDS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _bits(places) -> int:
    return sum(1 << k for k, o in enumerate(_NEAR) if o in places)


def _spread(near: Callable, within) -> tuple[np.ndarray, np.ndarray]:
    """For the lower and the upper 13 of 26 bits: what is next to any of the places that they stand for."""
    half = [np.zeros(1, np.int32), np.zeros(1, np.int32)]
    for k, o in enumerate(_NEAR):
        told = _bits([p for p in within if near(o, p)]) if o in within else 0
        half[k // 13] = np.concatenate([half[k // 13], half[k // 13] | told]).astype(np.int32)
    return half[0], half[1]


_TOUCHING, _SHARING = _spread(_touch, _NEAR), _spread(_share_face, _EDGE18)
_FACES, _NEARER = _bits(_FACE), _bits(_EDGE18)


def _flood(seeds: np.ndarray, within: np.ndarray, spread: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What can be reached from the seeds in each pattern."""
    while True:
        grown = seeds | (spread[0][seeds & 8191] | spread[1][seeds >> 13]) & within
        if (grown == seeds).all():
            return seeds
        seeds = grown


def _around(full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 26 neighbours of places within a volume as bits."""
    out, flat, (_, n, m) = np.zeros(len(at), np.int32), full.ravel(), full.shape
    places = (at[:, 0] * n + at[:, 1]) * m + at[:, 2]
    for k, o in enumerate(_NEAR):
        out |= flat[places + ((o[0] * n + o[1]) * m + o[2])].astype(np.int32) << k
    return out


def _goes(patterns: np.ndarray) -> np.ndarray:
    """Which neighbourhoods are those of simple voxels that aren't ends, as skeleton._simple has it, all at once."""
    p = patterns.astype(np.int32)
    empty = ~p & _NEARER
    faces = empty & _FACES
    going = (p & (p - 1) != 0) & (faces != 0)
    p, empty, faces = p[going], empty[going], faces[going]
    going[going] = (_flood(p & -p, p, _TOUCHING) == p) & (_flood(faces & -faces, empty, _SHARING) & _FACES == faces)
    return going


def peel(full: np.ndarray, odd: tuple[int, int, int]) -> None:
    """One iteration on a volume with an empty rim, in place; `odd` says by how much its places are off even coordinates."""
    inside = full[1:-1, 1:-1, 1:-1]
    covered = full[:-2, 1:-1, 1:-1] & full[2:, 1:-1, 1:-1] & full[1:-1, :-2, 1:-1] & full[1:-1, 2:, 1:-1] & full[1:-1, 1:-1, :-2] & full[1:-1, 1:-1, 2:]
    border = np.argwhere(inside & ~covered) + 1
    parity = (border + odd) % 2
    for sub in _SUBFIELDS:
        at = border[(parity == sub).all(1)]
        if len(at):
            at = at[_goes(_around(full, at))]
            full[at[:, 0], at[:, 1], at[:, 2]] = False


def thin(voxels: DataFrame, cut: Cut, block: int = BLOCK, iterations: int = ITERATIONS) -> DataFrame:
    """(grid_id, ix, iy, iz) of the medial curves of voxels(grid_id, ix, iy, iz); see the module. `cut` stores a round's
    voxels and returns them read back."""
    margin = EIGHT * iterations
    axes = ("ix", "iy", "iz")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.array(key[1:], np.int64) * block - margin - 1
        full = np.zeros((block + 2 * margin + 2,) * 3, bool)
        at = pdf[list(axes)].to_numpy() - low
        full[at[:, 0], at[:, 1], at[:, 2]] = True
        core = slice(margin + 1, margin + 1 + block)
        before = int(full[core, core, core].sum())
        for _ in range(iterations):
            peel(full, tuple(low % 2))
        left = np.argwhere(full[core, core, core]) + np.array(key[1:], np.int64) * block
        out = pd.DataFrame(left, columns=axes)
        out.insert(0, "grid_id", key[0])
        out["gone"] = before - len(out)
        return out

    # a voxel is sent to its own block and to those whose margin it is in
    reach = lambda a: F.sequence(F.floor((F.col(a) - margin) / block), F.floor((F.col(a) + margin) / block))
    now = cut(voxels.select(F.col("grid_id").cast("long").alias("grid_id"), *[F.col(a).cast("long").alias(a) for a in axes]).distinct().withColumn("gone", F.lit(1).cast("long")))
    while True:
        homes = [F.floor(F.col(a) / block).alias(f"b{a}") for a in axes]
        moved = now.where("gone > 0").select("grid_id", *homes).distinct()
        if moved.isEmpty():
            return now.drop("gone")
        # a block has to be looked at again if it or one around it has changed
        for a in axes:
            moved = moved.withColumn(f"b{a}", F.explode(F.sequence(F.col(f"b{a}") - -(-margin // block), F.col(f"b{a}") + -(-margin // block))))
        moved = moved.distinct()
        keys = ["grid_id", *[f"b{a}" for a in axes]]
        rows = now.select("grid_id", *axes, *homes)
        still = rows.join(moved, keys, "left_anti").select("grid_id", *axes, F.lit(0).cast("long").alias("gone"))
        sent = now.select("grid_id", *axes)
        for a in axes:
            sent = sent.withColumn(f"b{a}", F.explode(reach(a)))
        worked = sent.join(moved, keys, "left_semi").groupBy(*keys).applyInPandas(run, "grid_id long, ix long, iy long, iz long, gone long")
        now = cut(worked.unionByName(still))


def code(prefix: str = "i") -> Column:
    """A voxel as one number, ordered as (grid_id, ix, iy, iz)."""
    return F.col("grid_id").cast("long") * (1 << 48) + F.col(f"{prefix}x") * (1 << 32) + F.col(f"{prefix}y") * (1 << 16) + F.col(f"{prefix}z")


def place(v: str) -> list[Column]:
    c = F.col(v)
    part = lambda bits: F.shiftright(c, bits).bitwiseAND(F.lit(65535))
    return [F.shiftright(c, 48).alias("grid_id"), part(32).alias("x"), part(16).alias("y"), part(0).alias("z")]


def touching(voxels: DataFrame) -> DataFrame:
    """(a, b): pairs of voxels that touch, both ways, by their codes."""
    offsets = F.array(*[F.struct(*[F.lit(c).alias(k) for k, c in zip("xyz", o)]) for o in _NEAR])
    rows = voxels.select("grid_id", "ix", "iy", "iz", code().alias("a"), F.explode(offsets).alias("o"))
    rows = rows.select("grid_id", "a", *[(F.col(f"i{k}") + F.col(f"o.{k}")).alias(f"j{k}") for k in "xyz"])
    inside = [F.col(f"j{k}").between(0, 65535) for k in "xyz"]
    rows = rows.where(inside[0] & inside[1] & inside[2]).select("a", code("j").alias("b"))
    return rows.join(voxels.select(code().alias("b")), "b", "left_semi").select("a", "b")


def euler(voxels: DataFrame) -> DataFrame:
    """(grid_id, euler): Euler characteristics of voxels as closed cubes, by their distinct cells in doubled coordinates."""
    cell = F.array(*[F.struct(*[F.lit(c).alias(k) for k, c in zip("xyz", (a, b, c))]) for a in range(3) for b in range(3) for c in range(3)])
    cells = voxels.select("grid_id", "ix", "iy", "iz", F.explode(cell).alias("o")).select("grid_id", *[(2 * F.col(f"i{k}") + F.col(f"o.{k}")).alias(k) for k in "xyz"]).distinct()
    return cells.groupBy("grid_id").agg(F.sum(F.when((F.col("x") + F.col("y") + F.col("z")) % 2 == 1, -1).otherwise(1)).cast("bigint").alias("euler"))


def trace(voxels: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """(nodes, points) of thin voxels(grid_id, ix, iy, iz): nodes(node, grid_id, x, y, z), a node named by its least voxel, at
    the mean of its voxels; and points(grid_id, edge, u, v, seq, x, y, z) of the edges, from node u to v. An edge is named by
    its first step, a and b: from the lesser of its ends. A chain of one voxel that comes back to its node is no edge."""
    voxels = voxels.select("grid_id", "ix", "iy", "iz")
    pairs = cut(touching(voxels))
    every = voxels.select(code().alias("a"))
    degree = cut(every.join(pairs.groupBy("a").agg(F.count("*").alias("degree")), "a", "left").select("a", F.coalesce("degree", F.lit(0)).alias("degree")))
    with_b = pairs.join(degree.select(F.col("a").alias("b"), F.col("degree").alias("degree_b")), "b").join(degree, "a")
    with_b = cut(with_b.select("a", "b", "degree", "degree_b"))

    branch = components(with_b.where("degree > 2 AND degree_b > 2").select(F.col("a").alias("u"), F.col("b").alias("v")), cut).select(F.col("v").alias("a"), F.col("component").alias("node"))
    ends = degree.where("degree <> 2").join(branch, "a", "left").select("a", F.coalesce("node", "a").alias("node"))
    # chains that no node touches are rings; their least voxel is a node
    chain = with_b.where("degree = 2 AND degree_b = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = components(chain, cut)
    closed = parts.join(with_b.where("degree = 2 AND degree_b <> 2").select(F.col("a").alias("v")).distinct().join(parts, "v").select("component").distinct(), "component", "left_anti")
    rings = closed.select(F.col("component").alias("a"), F.col("component").alias("node")).distinct()
    node = cut(ends.unionByName(rings))
    spots = node.select("node", *place("a")).groupBy("node", "grid_id").agg(*[F.avg(k).alias(k) for k in "xyz"])

    # steps a -> b; a step from a node begins a path, any other follows the step that comes to a from its other neighbour
    steps = pairs.join(node.select("a", F.col("node").alias("from_")), "a", "left").join(node.select(F.col("a").alias("b"), F.col("node").alias("to")), "b", "left")
    steps = cut(steps.select("a", "b", "from_", "to"))
    direct = steps.where("from_ < to").select("a", "b", F.col("from_").alias("u"), F.col("to").alias("v"))
    into = steps.where("to IS NULL").select(F.col("a").alias("before"), F.col("b").alias("a"))
    later = steps.where("from_ IS NULL").join(into, "a").where("before <> b").select("a", "b", "to", F.col("before").alias("pa"), F.col("a").alias("pb"), F.lit(1).cast("long").alias("far"))
    first = steps.where("from_ IS NOT NULL AND to IS NULL").select("a", "b", "to", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(0).cast("long").alias("far"))
    # the root of a step whose pointer is null is itself
    now = cut(first.unionByName(later).select("a", "b", "to", "far", "pa", "pb", F.when(F.col("pa").isNull(), F.col("a")).alias("ra"), F.when(F.col("pa").isNull(), F.col("b")).alias("rb")))
    while not now.where("ra IS NULL").isEmpty():
        at = now.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("far").alias("far_"), F.col("pa").alias("pa_"), F.col("pb").alias("pb_"), F.col("ra").alias("ra_"), F.col("rb").alias("rb_"))
        open_ = now.where("ra IS NULL").drop("ra", "rb").join(at, ["pa", "pb"])
        jumped = open_.select("a", "b", "to", (F.col("far") + F.col("far_")).alias("far"), F.col("pa_").alias("pa"), F.col("pb_").alias("pb"), F.col("ra_").alias("ra"), F.col("rb_").alias("rb"))
        now = cut(now.where("ra IS NOT NULL").unionByName(jumped))

    # every chain is found from both ends: the one whose first step is less stays
    over = now.where("to IS NOT NULL").select("ra", "rb", F.col("far").alias("last"), F.col("a").alias("la"), F.col("b").alias("lb"), F.col("to").alias("v"))
    over = over.join(node.select(F.col("a").alias("ra"), F.col("node").alias("u")), "ra")
    ring = node.join(rings.select("a"), "a", "left_semi").select(F.col("a").alias("ra"), F.lit(True).alias("ring"))
    over = over.join(ring, "ra", "left").where("(lb > ra OR (lb = ra AND rb <= la)) AND (last > 1 OR u <> v OR ring)")
    over = cut(over.select("ra", "rb", "last", "lb", "u", "v"))
    path = now.select("ra", "rb", "a", F.col("far").alias("seq")).join(over, ["ra", "rb"]).select("ra", "rb", "u", "v", "seq", F.col("a").alias("p"))
    path = path.unionByName(over.select("ra", "rb", "u", "v", (F.col("last") + 1).alias("seq"), F.col("lb").alias("p")))
    straight = direct.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "u", "v", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.col("a").alias("p")), F.struct(F.lit(1).cast("long").alias("seq"), F.col("b").alias("p")))).alias("s")).select("ra", "rb", "u", "v", "s.seq", "s.p")
    points = path.unionByName(straight).select(F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("edge"), "u", "v", "seq", *place("p"))
    return spots, points
