"""Canonical keys of many small multigraphs: equal for two graphs exactly where one is the other with its vertices renamed.

Vertices are coloured by loops and by how many edges they have to each colour, until the colours stay. Where vertices still
share a colour, each vertex of the first such class in turn gets a colour of its own, and refining goes on; the key is the
least edge list over all ends of this tree. Two ends with the same list are a symmetry, and vertices that symmetries take
to each other, with the earlier choices fixed, need one try only, so symmetric graphs have small trees too.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edges = dict[tuple[int, int], int]


class _Search:
    def __init__(self, n: int, edges: Edges) -> None:
        self.n = n
        self.near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.loops = [0] * n
        for (u, v), m in edges.items():
            if u == v:
                self.loops[u] += m
            else:
                self.near[u].append((v, m))
                self.near[v].append((u, m))
        self.best: tuple | None = None
        self.order: list[int] = []
        #: Choices so far, and by depth the symmetry classes of the choices that fix the ones before.
        self.chosen: list[int] = []
        self.same: list[list[int]] = []

    def refined(self, colour: list[int]) -> list[int]:
        while True:
            told = [(colour[v], self.loops[v], tuple(sorted((colour[w], m) for w, m in self.near[v]))) for v in range(self.n)]
            names = {t: i for i, t in enumerate(sorted(set(told)))}
            new = [names[t] for t in told]
            if len(names) == len(set(colour)):
                return new
            colour = new

    def _end(self, colour: list[int]) -> None:
        at = [0] * self.n
        for v, c in enumerate(colour):
            at[c] = v
        links = [(*sorted((colour[v], colour[w])), m) for v in range(self.n) for w, m in self.near[v] if v < w]
        rows = tuple(sorted(links + [(colour[v], colour[v], k) for v, k in enumerate(self.loops) if k]))
        if self.best is None or rows < self.best:
            self.best, self.order = rows, at
        elif rows == self.best:
            to = dict(zip(self.order, at))
            for depth, root in enumerate(self.same):
                if all(to[v] == v for v in self.chosen[:depth]):
                    for v, w in to.items():
                        a, b = self._find(root, v), self._find(root, w)
                        root[max(a, b)] = min(a, b)

    @staticmethod
    def _find(root: list[int], v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    def run(self, colour: list[int]) -> None:
        colour = self.refined(colour)
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colour):
            cells.setdefault(c, []).append(v)
        cell = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
        if cell is None:
            return self._end(colour)
        root = list(range(self.n))
        self.same.append(root)
        tried: list[int] = []
        for v in cell:
            if any(self._find(root, v) == self._find(root, t) for t in tried):
                continue
            tried.append(v)
            self.chosen.append(v)
            self.run([2 * c + (w != v) for w, c in enumerate(colour)])
            self.chosen.pop()
        self.same.pop()


def canonical_form(n: int, edges: Edges) -> tuple:
    """(n, sorted (u, v, edges) after the canonical renaming) of a multigraph on vertices 0 to n - 1."""
    search = _Search(n, edges)
    search.run([0] * n)
    return n, search.best or ()


def keys(edges: DataFrame) -> DataFrame:
    """(graph_id, n, canonical_key) of edges(graph_id, u, v), parallel edges and loops included; vertices may be of any type. The
    edges between two vertices are counted first, so a graph's size here is that of its distinct pairs, and graphs that have
    the same ones, names included, are searched once."""
    pairs = edges.select("graph_id", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    pairs = pairs.groupBy("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("m"))
    graphs = pairs.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "m"))).alias("edges"))

    def run(batches):
        for b in batches:
            rows = []
            for us, vs, ms in zip(b["u"], b["v"], b["m"]):
                ids = {x: i for i, x in enumerate(sorted({*us, *vs}))}
                form = canonical_form(len(ids), {(ids[u], ids[v]): int(m) for u, v, m in zip(us, vs, ms)})
                rows.append((len(ids), hashlib.sha256(repr(form).encode()).hexdigest()))
            yield pd.DataFrame({"edges": b["edges"], "n": [r[0] for r in rows], "canonical_key": [r[1] for r in rows]})

    # the search takes longer than its rows are large: as many tasks as there may be, whatever their bytes
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = F.to_json("edges").alias("edges")
    each = graphs.select("graph_id", told)
    once = graphs.select(told, *[F.col(f"edges.{c}").alias(c) for c in "uvm"]).distinct().repartition(tasks, "edges")
    found = once.mapInPandas(run, "edges string, n int, canonical_key string")
    return each.join(found, "edges").select("graph_id", "n", "canonical_key")
