"""Numpy kernels, run by Arrow batches or by graph, for what columns can't express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def eigvalsh(rows: DataFrame, key: str, values: str, n: int, digits: int | None = 6) -> DataFrame:
    """(key, band, value): ascending eigenvalues of Hermitian n x n matrices, one batched solve per Arrow batch. `values`
    is an array whose first n entries are the diagonal, then real and imaginary parts of the upper triangle by rows.
    Eigenvalues are rounded to `digits`, if any."""
    upper = [(i, j) for i in range(n) for j in range(i + 1, n)]

    def run(batches):
        for b in batches:
            v = np.array([x[: n + 2 * len(upper)] for x in b[values]], float).reshape(len(b), -1)
            h = np.zeros((len(b), n, n), complex)
            h[:, range(n), range(n)] = v[:, :n]
            for k, (i, j) in enumerate(upper):
                h[:, i, j] = v[:, n + 2 * k] + 1j * v[:, n + 2 * k + 1]
                h[:, j, i] = np.conj(h[:, i, j])
            e = np.linalg.eigvalsh(h) if len(b) else np.zeros((0, n))
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), n), "band": np.tile(np.arange(n), len(b)), "value": (e.ravel() if digits is None else np.round(e.ravel(), digits)) + 0.0})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, values).mapInPandas(run, f"{key} {kind}, band int, value double")


# --- exact invariants of single graphs -------------------------------------------------------------------------------

Poly = dict[int, int]


def _times(p: Poly, q: Poly) -> Poly:
    out: Poly = {}
    for a, x in p.items():
        for b, y in q.items():
            out[a + b] = out.get(a + b, 0) + x * y
    return {e: c for e, c in out.items() if c}


def _plus(p: Poly, q: Poly) -> Poly:
    out = dict(p)
    for e, c in q.items():
        out[e] = out.get(e, 0) + c
    return {e: c for e, c in out.items() if c}


def sigma_polynomial(n: int, edges: list[tuple[int, int]], memo: dict | None = None) -> Poly:
    """The Yamada polynomial of an abstract multigraph on n vertices, in sigma = Y + 1 + 1/Y.

    One vertex is -1 and the empty graph 1; a loop multiplies by -sigma, parts multiply, and a bundle of m parallel edges
    between two vertices gives R(G - bundle) + c_m R(G / bundle) with c_m = 1 - sigma + sigma^2 - ..., m terms. A bridge
    therefore makes the whole 0."""
    memo = {} if memo is None else memo
    loops = sum(u == v for u, v in edges)
    bundles: dict[tuple[int, int], int] = {}
    for u, v in edges:
        if u != v:
            k = (min(u, v), max(u, v))
            bundles[k] = bundles.get(k, 0) + 1
    return _times({loops: (-1) ** loops}, _bundled(n, bundles, memo))


def _bundled(n: int, bundles: dict[tuple[int, int], int], memo: dict) -> Poly:
    if not bundles:
        return {0: (-1) ** n}
    ids = sorted({x for k in bundles for x in k})
    alone = n - len(ids)
    place = {x: i for i, x in enumerate(ids)}
    key = (len(ids), tuple(sorted((place[u], place[v], m) for (u, v), m in bundles.items())))
    if key not in memo:
        memo[key] = _connected_parts(len(ids), {(u, v): m for u, v, m in key[1]}, memo)
    return _times({0: (-1) ** alone}, memo[key])


def _connected_parts(n: int, bundles: dict[tuple[int, int], int], memo: dict) -> Poly:
    near: dict[int, set[int]] = {i: set() for i in range(n)}
    for u, v in bundles:
        near[u].add(v)
        near[v].add(u)
    seen, todo = {0}, [0]
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y)
            todo.append(y)
    if len(seen) < n:
        inside = {k: m for k, m in bundles.items() if k[0] in seen}
        outside = {k: m for k, m in bundles.items() if k[0] not in seen}
        return _times(_bundled(len(seen), inside, memo), _bundled(n - len(seen), outside, memo))
    u = min(near, key=lambda x: (len(near[x]), x))
    if len(near[u]) == 1 and bundles[min((u, next(iter(near[u]))), (next(iter(near[u])), u))] == 1:
        return {}
    v = min(near[u])
    edge = (min(u, v), max(u, v))
    m = bundles[edge]
    rest = {k: c for k, c in bundles.items() if k != edge}
    merged: dict[tuple[int, int], int] = {}
    for (a, b), c in rest.items():
        a, b = (edge[0] if a == edge[1] else a), (edge[0] if b == edge[1] else b)
        k = (min(a, b), max(a, b))
        merged[k] = merged.get(k, 0) + c
    share = {i: (-1) ** i for i in range(m)}
    return _plus(_bundled(n, rest, memo), _times(share, _bundled(n - 1, merged, memo)))


def sigma_terms(edges: DataFrame, key: str = "g") -> DataFrame:
    """(key, e, coeff) in sigma for edges(key, u, v) of many graphs, one kernel call per graph. A vertex without edges can
    be given as a row with null v."""
    kind = dict(edges.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {x: i for i, x in enumerate(sorted({str(x) for c in ("u", "v") for x in pdf[c].dropna()}))}
        pairs = [(ids[str(u)], ids[str(v)]) for u, v in zip(pdf["u"], pdf["v"]) if pd.notna(v)]
        p = sigma_polynomial(len(ids), pairs) or {0: 0}
        return pd.DataFrame({key: pdf[key].iloc[0], "e": list(p), "coeff": [str(c) for c in p.values()]})

    return edges.select(key, "u", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, e int, coeff string")


def negami(n: int, edges: list[tuple[int, int]]) -> dict[tuple[int, int, int], int]:
    """{(kept, components, cycle rank): subsets} over all subsets of the edges."""
    out: dict[tuple[int, int, int], int] = {}
    for mask in range(1 << len(edges)):
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        kept, parts = 0, n
        for k, (u, v) in enumerate(edges):
            if mask >> k & 1:
                kept += 1
                a, b = find(u), find(v)
                if a != b:
                    root[a] = b
                    parts -= 1
        key = (len(edges) - kept, parts, kept - n + parts)
        out[key] = out.get(key, 0) + 1
    return out


def negami_terms(edges: DataFrame, key: str = "g", most: int = 20) -> DataFrame:
    """(key, removed, mu, beta, n): counts of edge subsets. Each graph's subsets are 2^E, so E is limited."""
    kind = dict(edges.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {x: i for i, x in enumerate(sorted({*map(str, pdf["u"]), *map(str, pdf["v"])}))}
        if len(pdf) > most:
            raise ValueError(f"graph {pdf[key].iloc[0]} has {len(pdf)} edges; the expansion takes up to {most}")
        got = negami(len(ids), [(ids[str(u)], ids[str(v)]) for u, v in zip(pdf["u"], pdf["v"])])
        return pd.DataFrame([(pdf[key].iloc[0], *k, c) for k, c in got.items()], columns=[key, "removed", "mu", "beta", "n"])

    return edges.select(key, "u", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, removed int, mu int, beta int, n long")


def parse_code(code: str) -> list[tuple[str, list[int]]]:
    """[(kind, labels)] of a planar-diagram string."""
    import re

    out = []
    for token in (t.strip() for t in code.split(";")):
        if token:
            m = re.fullmatch(r"([VX])\[([0-9,]*)\]", token)
            if not m:
                raise ValueError(f"bad token {token!r}")
            out.append((m[1], [int(x) for x in m[2].split(",") if x]))
    return out


def diagram_states(code: str, compatible: bool = False):
    """(power, vertices, edges, free loops) of the 3^c smoothings of a diagram. Strands are traced through smoothed
    crossings; a closed strand without a vertex is a free loop. With `compatible`, a crossing that has been smoothed comes
    back as a vertex when a later one shares an arc with it, which gives the historical published values."""
    from itertools import product

    nodes = parse_code(code)
    crossings = [i for i, (k, _) in enumerate(nodes) if k == "X" and len(set(nodes[i][1])) == 4]
    skip = {i for i, (k, a) in enumerate(nodes) if k == "X" and i not in crossings}
    where: dict[int, list[int]] = {}
    for i, (_, labels) in enumerate(nodes):
        if i not in skip:
            for a in labels:
                where.setdefault(a, []).append(i)
    pairs = {0: ((0, 3), (1, 2)), 1: ((0, 1), (2, 3))}
    for spins in product((0, 1, 2), repeat=len(crossings)):
        power = spins.count(0) - spins.count(1)
        if compatible:
            yield (power, *_compatible(nodes, where, crossings, spins, pairs), 0)
            continue
        smooth = {i: s for i, s in zip(crossings, spins) if s < 2}
        root = {a: a for a in where}

        def find(a: int) -> int:
            while root[a] != a:
                a = root[a]
            return a

        loops = 0
        for i, s in smooth.items():
            for x, y in pairs[s]:
                a, b = find(nodes[i][1][x]), find(nodes[i][1][y])
                if a == b:
                    loops += 1
                else:
                    root[a] = b
        ends: dict[int, list[int]] = {}
        kept = [i for i in range(len(nodes)) if i not in smooth and i not in skip]
        for i in kept:
            for a in nodes[i][1]:
                ends.setdefault(find(a), []).append(i)
        ids = {i: k for k, i in enumerate(kept)}
        yield power, len(kept), [(ids[e[0]], ids[e[1]]) for e in ends.values() if len(e) == 2], loops


def state_rows(codes: DataFrame, compatible: bool = False) -> DataFrame:
    """(g, power, vertices, edges, loops) of every smoothing of codes(g, pd_code), in Arrow batches; 3^c rows a code."""

    def run(batches):
        for b in batches:
            for g, code in zip(b["g"], b["pd_code"]):
                rows = [(g, p, n, len(e), f) for p, n, e, f in diagram_states(code, compatible)]
                yield pd.DataFrame(rows, columns=["g", "power", "vertices", "edges", "loops"])

    return codes.select("g", "pd_code").mapInPandas(run, f"g {dict(codes.dtypes)['g']}, power int, vertices int, edges int, loops int")


def _compatible(nodes, where, crossings, spins, pairs):
    """The graph after each crossing in turn is replaced by edges between the nodes that its arcs led to at first."""
    edges = [(e[0], e[1]) if len(e) == 2 else (e[0], e[0]) for e in where.values()]
    alive = {i for e in edges for i in e} | {i for i, (k, a) in enumerate(nodes) if not a}
    for i, s in zip(crossings, spins):
        if s == 2:
            continue
        edges = [e for e in edges if i not in e]
        alive.discard(i)
        far = []
        for a in nodes[i][1]:
            e = where[a]
            far.append(e[1] if e[0] == i else e[0])
        for x, y in pairs[s]:
            edges.append((far[x], far[y]))
            alive |= {far[x], far[y]}
    ids = {x: k for k, x in enumerate(sorted(alive))}
    return len(ids), [(ids[u], ids[v]) for u, v in edges]


def yamada_diagram(code: str, compatible: bool = False, normalised: bool = True) -> Poly:
    """The Yamada polynomial of a diagram in A, lowest exponent 0 if normalised."""
    labels = [a for kind, x in parse_code(code) for a in x if kind == "V" or len(set(x)) == 4]
    if any(labels.count(a) != 2 for a in set(labels)):
        raise ValueError("a label doesn't occur twice")
    total: Poly = {}
    memo: dict = {}
    powers = [{0: 1}]
    for power, n, edges, loops in diagram_states(code, compatible):
        p = sigma_polynomial(n, edges, memo)
        for e, c in p.items():
            while len(powers) <= e + loops:
                powers.append(_times(powers[-1], {-1: 1, 0: 1, 1: 1}))
            total = _plus(total, _times({power: c}, powers[e + loops]))
    if normalised and total:
        low = min(total)
        total = {e - low: -c if low % 2 else c for e, c in total.items()}
    return total


def diagram_terms(codes: DataFrame, compatible: bool = False) -> DataFrame:
    """(g, e, coeff) of codes(g, pd_code), row by row in Arrow batches; a code that is off the grammar, or has labels
    that don't occur twice, gives no terms, and the zero polynomial a zero term."""

    def run(batches):
        for b in batches:
            rows = []
            for g, code in zip(b["g"], b["pd_code"]):
                try:
                    rows += [(g, e, str(c)) for e, c in (yamada_diagram(code, compatible) or {0: 0}).items()]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["g", "e", "coeff"])

    return codes.select("g", "pd_code").mapInPandas(run, f"g {dict(codes.dtypes)['g']}, e int, coeff string")


def to_sigma(p: Poly) -> Poly:
    """A Laurent polynomial that is unchanged by Y -> 1/Y, in sigma; anything else is an error."""
    if any(p.get(-e, 0) != c for e, c in p.items()):
        raise ValueError("not symmetric")
    left, out, powers = dict(p), {}, [{0: 1}]
    while left:
        e = max(left)
        while len(powers) <= e:
            powers.append(_times(powers[-1], {-1: 1, 0: 1, 1: 1}))
        out[e] = left[e]
        left = _plus(left, {k: -left[e] * c for k, c in powers[e].items()})
    return out


def sigma_of(terms: DataFrame) -> DataFrame:
    """(g, e, coeff) in sigma of symmetric terms(g, e, coeff) in Y."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = to_sigma({int(e): int(c) for e, c in zip(pdf["e"], pdf["coeff"]) if int(c)})
        return pd.DataFrame({"g": pdf["g"].iloc[0], "e": list(p), "coeff": [str(c) for c in p.values()]})

    rows = terms.select("g", "e", terms["coeff"].cast("string").alias("coeff"))
    return rows.groupBy("g").applyInPandas(run, f"g {dict(terms.dtypes)['g']}, e int, coeff string")


def has_clique_minor(n: int, edges: set[frozenset[int]], k: int) -> bool:
    """Whether a simple graph has the complete graph on k vertices as a minor, by contraction; for small graphs."""
    seen: set = set()

    def search(vertices: frozenset, links: frozenset) -> bool:
        if len(vertices) < k or len(links) < k * (k - 1) // 2:
            return False
        if (vertices, links) in seen:
            return False
        seen.add((vertices, links))
        degree = {v: sum(v in e for e in links) for v in vertices}
        if len(vertices) == k:
            return len(links) == k * (k - 1) // 2
        low = next((v for v in sorted(vertices) if degree[v] < min(2, k - 1)), None)
        if low is not None:
            return search(vertices - {low}, frozenset(e for e in links if low not in e))
        for e in sorted(links, key=sorted):
            a, b = sorted(e)
            merged = frozenset(x for x in (frozenset(a if y == b else y for y in f) for f in links) if len(x) == 2)
            if search(vertices - {b}, merged):
                return True
        return False

    return search(frozenset(range(n)), frozenset(edges))


def _holds(links: frozenset, vertices: list[int], host: list[tuple[int, int]], size: int) -> bool:
    """Whether a simple graph has one with vertices 0 to size - 1 as a subgraph, by backtracking."""
    near = {v: {x for e in links if v in e for x in e if x != v} for v in vertices}
    want = {i: {b if a == i else a for a, b in host if i in (a, b)} for i in range(size)}

    def place(i: int, at: dict[int, int]) -> bool:
        if i == size:
            return True
        for v in vertices:
            if v not in at.values() and len(near[v]) >= len(want[i]) and all(at[j] in near[v] for j in want[i] if j < i):
                if place(i + 1, at | {i: v}):
                    return True
        return False

    return place(0, {})


def has_minor(n: int, edges: set[frozenset[int]], host: list[tuple[int, int]], size: int) -> bool:
    """Whether a simple graph on n vertices has any simple graph, the edges `host` on `size` vertices, as a minor: as a
    subgraph after some contractions. For small graphs."""
    seen: set = set()

    def search(vertices: frozenset, links: frozenset) -> bool:
        if len(vertices) < size or len(links) < len(host) or (vertices, links) in seen:
            return False
        seen.add((vertices, links))
        if _holds(links, sorted(vertices), host, size):
            return True
        for a, b in sorted(map(sorted, links)):
            merged = frozenset(x for x in (frozenset(a if y == b else y for y in f) for f in links) if len(x) == 2)
            if search(vertices - {b}, merged):
                return True
        return False

    return search(frozenset(range(n)), frozenset(edges))


def host_minors(edges: DataFrame, hosts: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """(graph_id, <name>...): which of the small graphs `hosts`, lists of edges over vertices from 0, are minors of the
    simple graphs edges(graph_id, u, v)."""
    kind = dict(edges.dtypes)["graph_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {x: i for i, x in enumerate(sorted({*pdf["u"], *pdf["v"]}))}
        links = {frozenset((ids[u], ids[v])) for u, v in zip(pdf["u"], pdf["v"]) if u != v}
        return pd.DataFrame([{"graph_id": pdf["graph_id"].iloc[0], **{name: has_minor(len(ids), links, h, 1 + max(map(max, h))) for name, h in hosts.items()}}])

    return edges.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, " + ", ".join(f"{n} boolean" for n in hosts))


def minors(edges: DataFrame, cliques: dict[str, int]) -> DataFrame:
    """(graph_id, <name>...): clique minors of the small simple graphs edges(graph_id, u, v)."""
    kind = dict(edges.dtypes)["graph_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {x: i for i, x in enumerate(sorted({*pdf["u"], *pdf["v"]}))}
        links = {frozenset((ids[u], ids[v])) for u, v in zip(pdf["u"], pdf["v"]) if u != v}
        return pd.DataFrame([{"graph_id": pdf["graph_id"].iloc[0], **{name: has_clique_minor(len(ids), links, k) for name, k in cliques.items()}}])

    return edges.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, " + ", ".join(f"{n} boolean" for n in cliques))
