"""Golden values and properties of the numpy kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.operators import kernels as k
from skeinwork.operators import skeleton

# Sigma polynomials {exponent: coefficient} of small graphs.
GOLDEN = {
    "K3": (3, [(0, 1), (1, 2), (0, 2)], {1: 1}),
    "K4": (4, [(i, j) for i in range(4) for j in range(i)], {3: 1, 2: -3, 1: 2}),
    "K5": (5, [(i, j) for i in range(5) for j in range(i)], {6: -1, 5: 4, 4: -10, 3: 15, 2: -15, 1: 6}),
    "K33": (6, [(i, j) for i in range(3) for j in range(3, 6)], {4: -1, 3: 5, 2: -9, 1: 5}),
    "path": (3, [(0, 1), (1, 2)], {}),
    "point": (1, [], {0: -1}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_sigma_golden(name):
    n, edges, want = GOLDEN[name]
    assert k.sigma_polynomial(n, edges) == want


def test_hopf_both_smoothings():
    for code in ("V[0,2];V[3,5];X[1,4,0,5];X[3,2,4,1]", "V[0,2];V[3,5];X[4,1,3,2];X[0,5,1,4]"):
        assert k.yamada_diagram(code) == dict.fromkeys(range(9), 1)
        assert k.yamada_diagram(code, compatible=True) == {0: 1, 1: 1, 2: 1, 4: -1, 5: -2, 6: -2, 7: -1}


graphs = st.integers(1, 5).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=7)))


@settings(max_examples=60, deadline=None)
@given(graphs)
def test_sigma_equals_subset_expansion(g):
    n, edges = g
    want: dict = {}
    for (_, mu, beta), count in k.negami(n, edges).items():
        # y = -(A + 2 + 1/A) = -(sigma + 1)
        for i in range(beta + 1):
            want[i] = want.get(i, 0) + (-1) ** (mu + beta) * count * math.comb(beta, i)
    assert k.sigma_polynomial(n, edges) == {e: c for e, c in want.items() if c}


@settings(max_examples=40, deadline=None)
@given(graphs)
def test_sigma_round_trip(g):
    p = k.sigma_polynomial(*g)
    y: dict = {}
    for e, c in p.items():
        power = {0: 1}
        for _ in range(e):
            power = k._times(power, {-1: 1, 0: 1, 1: 1})
        y = k._plus(y, k._times(power, {0: c}))
    assert k.to_sigma(y) == p


def test_minors():
    k4 = {frozenset((i, j)) for i in range(4) for j in range(i)}
    assert k.has_clique_minor(4, k4, 3) and k.has_clique_minor(4, k4, 4)
    ring = {frozenset((i, (i + 1) % 6)) for i in range(6)}
    assert k.has_clique_minor(6, ring, 3) and not k.has_clique_minor(6, ring, 4)
    assert not k.has_clique_minor(4, {frozenset((0, i)) for i in range(1, 4)}, 3)


def mask(n, gamma):
    x = np.linspace(-np.pi, np.pi, n)
    a, b, c = np.meshgrid(x, x, np.linspace(0, np.pi, n), indexing="ij")
    z, w = (np.cos(2 * c) + 0.5) + 1j * (np.cos(a) + np.cos(b) + np.cos(c) - 2), np.sin(a) + 1j * np.sin(b)
    return set(map(tuple, np.argwhere(np.abs(z * z - w * w) ** 2 <= gamma * gamma).tolist()))


def test_thinning_keeps_topology():
    voxels = mask(32, 0.4)
    thin = skeleton.thin(voxels)
    assert thin <= voxels and skeleton.thin(thin) == thin
    places, edges = skeleton.trace(thin)
    assert (len(places), len(edges)) == (2, 3)
    assert skeleton.thin({(0, 0, 0)}) == {(0, 0, 0)} and skeleton.thin(set()) == set()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-5, 5)] * 3), min_size=1, max_size=25), st.floats(0.01, 1))
def test_rdp_stays_near(points, eps):
    p = np.array(points)
    q = skeleton.rdp(p, eps)
    assert (q[0] == p[0]).all() and (q[-1] == p[-1]).all()
    for x in p:
        if len(q) > 1:
            best = min(np.linalg.norm(x - (a + np.clip((x - a) @ (b - a) / max((b - a) @ (b - a), 1e-30), 0, 1) * (b - a))) for a, b in zip(q, q[1:]))
            assert best <= eps + 1e-9
