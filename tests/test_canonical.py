"""Canonical keys under renaming, and of graphs that are hard to tell apart."""

import random
from itertools import combinations, permutations

from skeinwork.operators.canonical import canonical_form, keys


def plain(pairs):
    out = {}
    for u, v in pairs:
        k = (min(u, v), max(u, v))
        out[k] = out.get(k, 0) + 1
    return out


def renamed(r, n, edges):
    p = list(range(n))
    r.shuffle(p)
    return {(min(p[u], p[v]), max(p[u], p[v])): m for (u, v), m in edges.items()}


def circulant(n, steps):
    return n, plain({(min(i, (i + s) % n), max(i, (i + s) % n)) for i in range(n) for s in steps})


def prism(n):
    return 2 * n, plain([(i, (i + 1) % n) for i in range(n)] + [(n + i, n + (i + 1) % n) for i in range(n)] + [(i, n + i) for i in range(n)])


PETERSEN = 10, plain([(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)])
# fixed values: two pairs of different graphs with the same spectrum
STAR, SQUARE = (5, plain([(0, 1), (0, 2), (0, 3), (0, 4)])), (5, plain([(0, 1), (1, 2), (2, 3), (3, 0)]))
ROOK = 16, plain([(a, b) for a, b in combinations(range(16), 2) if a // 4 == b // 4 or a % 4 == b % 4])
SHRIKHANDE = 16, plain([(a, b) for a, b in combinations(range(16), 2) if ((a // 4 - b // 4) % 4, (a % 4 - b % 4) % 4) in {(0, 1), (0, 3), (1, 0), (3, 0), (1, 1), (3, 3)}])


def test_renaming_leaves_the_key():
    r = random.Random(1)
    graphs = [circulant(n, s) for n in (7, 8, 12, 13) for s in ((1,), (1, 2), (1, 3), (2, 4))] + [prism(n) for n in (3, 4, 6)] + [PETERSEN, STAR, SQUARE, ROOK, SHRIKHANDE]
    graphs += [(n, plain([(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 20))])) for n in (1, 3, 6, 9) for _ in range(5)]
    for k in range(1000):
        n, edges = graphs[k % len(graphs)]
        assert canonical_form(n, renamed(r, n, edges)) == canonical_form(n, edges)


def test_different_graphs_have_different_keys():
    for (n, a), (m, b) in ((STAR, SQUARE), (ROOK, SHRIKHANDE), (prism(5), PETERSEN), (circulant(12, (1, 2)), circulant(12, (1, 3)))):
        assert n == m and len(a) == len(b) or (n, m) == (5, 5)
        assert canonical_form(n, a) != canonical_form(m, b)


def test_all_graphs_of_four_vertices():
    """11 simple graphs on four vertices up to renaming; the same classes as by trying all renamings."""
    every = list(combinations(range(4), 2))
    by_key, by_hand = {}, {}
    for mask in range(64):
        edges = plain(e for i, e in enumerate(every) if mask >> i & 1)
        by_key.setdefault(canonical_form(4, edges), set()).add(mask)
        least = min(tuple(sorted(tuple(sorted((p[u], p[v]))) for u, v in edges)) for p in permutations(range(4)))
        by_hand.setdefault(least, set()).add(mask)
    assert len(by_key) == 11 and sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_hand.values()))


def test_keys_of_tables(spark):
    rows = [("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 9, 9), ("b", 9, 4), ("b", 4, 9), ("c", 1, 2), ("c", 2, 2), ("c", 1, 1)]
    got = {r["graph_id"]: (r["n"], r["canonical_key"]) for r in keys(spark.createDataFrame(rows, "graph_id string, u long, v long")).collect()}
    assert got["a"] == got["b"] != got["c"] and got["c"][0] == 2
    assert keys(spark.createDataFrame([], "graph_id string, u long, v long")).count() == 0


def test_graphs_with_the_same_edges_are_searched_once(spark, tmp_path):
    """A search leaves a file in a folder; 200 graphs with two edge lists, in any order of their rows, take two."""
    from skeinwork.operators import canonical

    plain_form, at = canonical.canonical_form, str(tmp_path)

    def counted(n, edges):
        import tempfile

        tempfile.mkstemp(dir=at)
        return plain_form(n, edges)

    rows = [(g, *e) for g in range(200) for e in ([(1, 2), (2, 3), (2, 1)] if g % 2 else [(3, 2), (1, 2), (2, 2)])[:: 1 if g % 4 < 2 else -1]]
    canonical.canonical_form = counted
    try:
        got = keys(spark.createDataFrame(rows, "graph_id long, u long, v long")).collect()
    finally:
        canonical.canonical_form = plain_form
    assert len(got) == 200 and len({r["canonical_key"] for r in got}) == 2 and len(list(tmp_path.iterdir())) == 2
