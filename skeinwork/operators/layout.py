"""Planar relaxation of diagrams with guards: no step may make segments cross, nor turn over the order around a vertex."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def forces(p: np.ndarray, a: np.ndarray, b: np.ndarray, rest: np.ndarray, repulsion: float, stiffness: float) -> np.ndarray:
    """Forces on points p: repulsion / d^2 between all pairs, and stiffness * ln(d / rest) along springs a to b."""
    d = p[:, None] - p[None]
    far = (d**2).sum(-1) + 1e-6
    weight = repulsion / (far * np.sqrt(far))
    np.fill_diagonal(weight, 0)
    out = (weight[..., None] * d).sum(1)
    e = p[b] - p[a]
    n = np.sqrt((e**2).sum(1) + 1e-6)
    pull = (stiffness * np.log(n / rest) / n)[:, None] * e
    np.add.at(out, a, pull)
    np.add.at(out, b, -pull)
    return out


def crossed(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of segments cross properly; those that share an end never do."""
    turn = lambda o, s, t: (s[..., 0] - o[..., 0]) * (t[..., 1] - o[..., 1]) - (s[..., 1] - o[..., 1]) * (t[..., 0] - o[..., 0])
    s, t = p[a][:, None], p[b][:, None]
    u, v = p[a][None], p[b][None]
    found = (turn(s, t, u) * turn(s, t, v) < 0) & (turn(u, v, s) * turn(u, v, t) < 0)
    shared = (a[:, None] == a[None]) | (a[:, None] == b[None]) | (b[:, None] == a[None]) | (b[:, None] == b[None])
    return found & ~shared


def orders(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, ...]]:
    """The neighbours around each vertex of three springs or more, counter-clockwise from the least."""
    near: dict[int, list[int]] = {}
    for i, j in zip(a.tolist(), b.tolist()):
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    out = []
    for i in sorted(near):
        if len(near[i]) > 2:
            around = sorted(near[i], key=lambda j: (float(np.arctan2(*(p[j] - p[i])[::-1])), j))
            k = around.index(min(around))
            out.append((i, *around[k:], *around[:k]))
    return out


def relax(p: np.ndarray, a: np.ndarray, b: np.ndarray, rest: np.ndarray, repulsion: float, stiffness: float, dt: float, steps: int, least: float, settled: float) -> tuple[np.ndarray, int, str]:
    """(points, steps taken, status): a step that breaks a guard isn't taken, and the next ones are half as long. settled:
    the largest move under which the layout has come to rest; least: the step length at which it is stuck."""
    now, around, taken = crossed(p, a, b), orders(p, a, b), 0
    for _ in range(steps):
        new = p + dt * forces(p, a, b, rest, repulsion, stiffness)
        then = crossed(new, a, b)
        if (then & ~now).any() or orders(new, a, b) != around:
            dt /= 2
            if dt < least:
                return p, taken, "stuck"
            continue
        move = float(np.sqrt(((new - p) ** 2).sum(1)).max(initial=0))
        p, now, taken = new, then, taken + 1
        if move < settled:
            return p, taken, "settled"
    return p, taken, "steps"


def layout(particles: DataFrame, springs: DataFrame, repulsion: float = 0.01, stiffness: float = 0.1, dt: float = 0.05, steps: int = 200, least: float = 1e-6, settled: float = 1e-6) -> DataFrame:
    """(g, pid, x, y, steps, status) of particles(g, pid, x, y) and springs(g, a, b, rest): one diagram g is one kernel call,
    diagrams go side by side. Springs whose ends aren't among the particles are left out."""
    kind = dict(particles.dtypes)["g"]

    def run(points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("pid").reset_index(drop=True)
        at = {x: i for i, x in enumerate(points["pid"])}
        links = links[links["a"].isin(at) & links["b"].isin(at)].sort_values(["a", "b"])
        a, b = (np.array([at[x] for x in links[c]], int) for c in "ab")
        p, n, status = relax(points[["x", "y"]].to_numpy(float), a, b, links["rest"].to_numpy(float), repulsion, stiffness, dt, steps, least, settled)
        return pd.DataFrame({"g": points["g"], "pid": points["pid"], "x": p[:, 0], "y": p[:, 1], "steps": n, "status": status})

    pair = particles.select("g", "pid", "x", "y").groupBy("g").cogroup(springs.select("g", "a", "b", "rest").groupBy("g"))
    return pair.applyInPandas(run, f"g {kind}, pid long, x double, y double, steps int, status string")
