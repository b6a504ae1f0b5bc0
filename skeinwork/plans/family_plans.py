"""Queries of graph families and polynomials, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import families as fam
from ..operators import kernels
from ..operators import polynomials as poly
from ..sources import dataset
from .common import shared_dir


def params(spark, d, second):
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") % 8 + 3).cast("int").alias("a")).distinct()
    return p.withColumn("b", F.expr(f"cast({second or 0} as int)"))


def _pairs(n, holds, u="CAST(i AS VARCHAR)", v="CAST(j AS VARCHAR)"):
    """Pairs i < j of n numbered vertices for which a test holds."""
    return f"SELECT a, b, {u} AS u, {v} AS v FROM (SELECT a, b, i, unnest(range({n})) j FROM (SELECT a, b, unnest(range({n})) i FROM p)) WHERE i < j AND ({holds})"


def _each(n, u, v):
    """An edge for each number i below n."""
    return f"SELECT a, b, {u} AS u, {v} AS v FROM (SELECT a, b, unnest(range({n})) i FROM p)"


def _board(w):
    """Labels row_column of vertices numbered by rows of w."""
    return f"(i // {w}) || '_' || (i % {w})", f"(j // {w}) || '_' || (j % {w})"


_STEP = lambda w: f"abs(i // {w} - j // {w}) + abs(i % {w} - j % {w}) = 1"
#: family: its DuckDB twin, which tests pairs of vertices where the operator generates edges.
TWINS = {
    "bouquet": _each("a", "'0'", "'0'"),
    "theta": _each("a", "'0'", "'1'"),
    "periodic_theta": " UNION ALL ".join([_each("a", "'L'", "'m' || i"), _each("a", "'m' || i", "'R'"), _pairs("a", "j = i + 1 OR j = i + a - 1", "'m' || i", "'m' || j")]),
    "sierpinski": _pairs("a * a", "i // a = j // a OR (i // a = j % a AND i % a = j // a)"),
    "complete_graph": _pairs("a", "true"),
    "complete_bipartite": _pairs("a + b", "i < a AND j >= a", "'l' || i", "'r' || (j - a)"),
    "complete_multipartite": " UNION ALL ".join([_pairs("a + b", "i < a AND j >= a", "'l' || i", "'m' || (j - a)"), _each("a", "'l' || i", "'r0'"), _each("b", "'m' || i", "'r0'")]),
    "fan": " UNION ALL ".join([_each("a", "'c'", "CAST(i AS VARCHAR)"), _pairs("a", "j = i + 1")]),
    "wheel": " UNION ALL ".join([_each("a", "'c'", "CAST(i AS VARCHAR)"), _pairs("a", "j = i + 1 OR j = i + a - 1")]),
    "ladder": _pairs("2 * a", _STEP(2), *_board(2)),
    "circular_ladder": _pairs("2 * a", f"{_STEP(2)} OR (i % 2 = j % 2 AND j - i = 2 * (a - 1))", *_board(2)),
    "grid": _pairs("a * b", _STEP("b"), *_board("b")),
    "cylinder": _pairs("a * b", f"{_STEP('b')} OR (i // b = j // b AND j - i = b - 1)", *_board("b")),
    "hypercube": _pairs("1 << a", "bit_count(xor(i, j)) = 1"),
    "friendship": " UNION ALL ".join([_each("2 * a", "'c'", "CAST(i AS VARCHAR)"), _pairs("2 * a", "i % 2 = 0 AND j = i + 1")]),
    "windmill": " UNION ALL ".join([_each("b * (a - 1)", "'c'", "(i // (a - 1)) || '_' || (i % (a - 1))"), _pairs("b * (a - 1)", "i // (a - 1) = j // (a - 1)", *_board("(a - 1)"))]),
    "circulant": _pairs("a", "least(j - i, a - j + i) <= b"),
    "generalized_petersen": " UNION ALL ".join([_pairs("a", "j = i + 1 OR j = i + a - 1"), _each("a", "CAST(i AS VARCHAR)", "'n' || i"), _pairs("a", "j = i + b OR j = i + a - b", "'n' || i", "'n' || j")]),
    "mobius_ladder": _pairs("2 * a", "j - i IN (1, a, 2 * a - 1)"),
}


def family_sql(name):
    return f"WITH p AS (SELECT DISTINCT CAST(p_size % 8 + 3 AS INTEGER) a, CAST({fam.FAMILIES[name].second or 0} AS INTEGER) b FROM part), e AS ({TWINS[name]}) SELECT a, b, least(u, v) AS u, greatest(u, v) AS v FROM e"


def family(name):
    f = fam.FAMILIES[name]

    def run(spark, d):
        return fam.normalised(fam.edges(params(spark, d, f.second), name))

    return run, family_sql(name)


def small_edges(spark):
    """Edges of every family at its small parameters, g names graph and parameters."""
    out = None
    for name, f in fam.FAMILIES.items():
        top = {"sierpinski": 3, "hypercube": 3, "complete_graph": 6, "complete_multipartite": 3}.get(name, 5)
        p = spark.range(max(1, f.least), top + 1, numPartitions=1).select(F.col("id").cast("int").alias("a"), F.expr(f"cast({f.second or 0} as int)").alias("b"))
        e = fam.edges(p, name).select(F.concat_ws("_", F.lit(name), "a", "b").alias("g"), "u", "v")
        out = e if out is None else out.unionByName(e)
    return out


def _sigma(spark, d):
    return poly.text(poly.clean(kernels.sigma_terms(small_edges(spark)).withColumn("coeff", F.col("coeff").cast(poly.EXACT))))


def _recursive(spark, d):
    p = kernels.sigma_terms(small_edges(spark)).withColumn("coeff", F.col("coeff").cast(poly.EXACT))
    return poly.text(poly.expand_sigma(p, 40))


def _back(spark, d):
    p = kernels.sigma_terms(small_edges(spark)).withColumn("coeff", F.col("coeff").cast(poly.EXACT))
    y = poly.expand_sigma(p, 40)
    return poly.text(kernels.sigma_of(y).withColumn("coeff", F.col("coeff").cast(poly.EXACT)))


def _dataset(spark, d):
    """The family dataset: name, parameters, both polynomials."""
    p = kernels.sigma_terms(small_edges(spark)).withColumn("coeff", F.col("coeff").cast(poly.EXACT))
    return poly.text(poly.clean(p), "yamada_sigma").join(poly.text(poly.expand_sigma(p, 40), "yamada"), "g", "left").select(F.col("g").alias("graph"), "yamada", "yamada_sigma")


def tiny(spark):
    names = ("theta", "fan", "wheel", "periodic_theta")
    out = None
    for name in names:
        p = spark.range(3, 4).select(F.col("id").cast("int").alias("a"), F.lit(0).alias("b"))
        e = fam.edges(p, name).select(F.lit(name).alias("g"), "u", "v")
        out = e if out is None else out.unionByName(e)
    return out


def _negami(spark, d):
    return kernels.negami_terms(tiny(spark)).select("g", "removed", "beta", "mu", "n")


def _abstract(spark, d):
    """h(G; x = -1, y = -A - 2 - 1/A) by joins: each subset count times (-1)^mu and a power of y."""
    h = kernels.negami_terms(tiny(spark))
    powers = yb(spark, 12)
    rows = h.join(powers, h["beta"] == powers["k"]).select("g", F.col("y").alias("e"), (F.when(F.col("mu") % 2 == 0, 1).otherwise(-1) * F.col("n") * F.col("c")).cast(poly.EXACT).alias("coeff"))
    return poly.text(poly.clean(rows))


def yb(spark, top):
    """(k, y, c) of (-A - 2 - 1/A)^k."""
    rows, now = [], {0: 1}
    for k in range(top + 1):
        rows += [(k, e, c) for e, c in now.items()]
        nxt = {}
        for e, c in now.items():
            for step, f in ((-1, -1), (0, -2), (1, -1)):
                nxt[e + step] = nxt.get(e + step, 0) + f * c
        now = nxt
    return spark.createDataFrame(rows, "k int, y int, c long")


HOPF = [("hopf_1", "V[0,2];V[3,5];X[1,4,0,5];X[3,2,4,1]"), ("hopf_2", "V[0,2];V[3,5];X[4,1,3,2];X[0,5,1,4]"), ("ring", "V[0,0]"), ("point", "V[]"), ("theta", "V[0,1,2];V[2,1,0]")]


def codes(spark):
    return spark.createDataFrame(HOPF, "g string, pd_code string")


def _states(spark, d):
    rows = kernels.state_rows(codes(spark))
    return rows.groupBy("g", "power").agg(F.count("*").alias("states"), F.sum("edges").alias("edges"), F.sum("loops").alias("loops"))


def _diagram(compatible):
    def run(spark, d):
        return poly.text(poly.clean(kernels.diagram_terms(codes(spark), compatible).withColumn("coeff", F.col("coeff").cast(poly.EXACT))))

    return run


# subsets of the edges of the networks of tiny(), by number, with the parts that each leaves
SUBSETS = "WITH RECURSIVE p AS (SELECT 3 a, 0 b), e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY u, v) - 1 i FROM (" + " UNION ALL ".join(f"SELECT '{n}' g, u, v FROM ({TWINS[n]})" for n in ("theta", "fan", "wheel", "periodic_theta")) + """)),
vs AS (SELECT g, u x FROM e UNION SELECT g, v FROM e), c AS (SELECT g, count(*) ne FROM e GROUP BY g), ms AS (SELECT g, ne, unnest(range(CAST(1 << ne AS BIGINT))) mask FROM c),
k AS (SELECT ms.g, mask, u, v FROM ms JOIN e ON e.g = ms.g AND (mask >> i) & 1 = 1), b AS (SELECT g, mask, u, v FROM k UNION SELECT g, mask, v, u FROM k),
r AS (SELECT ms.g, mask, x, x y FROM ms JOIN vs ON vs.g = ms.g UNION SELECT r.g, r.mask, r.x, b.v FROM r JOIN b ON b.g = r.g AND b.mask = r.mask AND b.u = r.y),
m AS (SELECT g, mask, count(DISTINCT l) mu, count(*) nv FROM (SELECT g, mask, x, min(y) l FROM r GROUP BY ALL) GROUP BY g, mask),
h AS (SELECT g, CAST(ne - bit_count(mask) AS INTEGER) AS removed, CAST(bit_count(mask) - nv + mu AS INTEGER) AS beta, CAST(mu AS INTEGER) AS mu, count(*) AS n FROM m JOIN c USING (g) GROUP BY ALL)"""
# (-A - 2 - 1/A)^k is (-1)^k (A + 1)^2k / A^k
ABSTRACT = SUBSETS + ", t AS (SELECT g, e, sum(n * CASE WHEN (mu + beta) % 2 = 0 THEN 1 ELSE -1 END * CAST(factorial(2 * beta) // (factorial(CAST(beta + e AS INTEGER)) * factorial(CAST(beta - e AS INTEGER))) AS BIGINT)) c FROM (SELECT *, unnest(range(-beta, beta + 1)) e FROM h) GROUP BY g, e HAVING c <> 0) SELECT g, string_agg(e || ':' || c, ' ' ORDER BY e) AS poly FROM t GROUP BY g"


def _known(hopf):
    """Polynomials of the codes, lowest exponent 0. A point is -1, a ring sigma, three edges sigma less its
    square; the Hopf link has its nine equal terms, or the published ones with compatible smoothing."""
    rows = {"hopf_1": hopf, "hopf_2": hopf, "ring": "0:-1 1:-1 2:-1", "point": "0:-1", "theta": "0:-1 1:-1 2:-2 3:-1 4:-1"}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{p}')" for g, p in rows.items()) + ") t(g, poly)"


def events_poly(spark, d, col):
    """A polynomial per user: exponents and coefficients from events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 20).cast("bigint").alias("g"), (F.col("event_id") % 5 - 2).cast("int").alias("e"), (F.col("event_id") % col - col // 2).cast(poly.EXACT).alias("coeff"))


P = "p AS (SELECT CAST(user_id % 20 AS BIGINT) g, CAST(event_id % 5 - 2 AS INTEGER) e, CAST(event_id % 7 - 3 AS HUGEINT) c FROM events), q AS (SELECT CAST(user_id % 20 AS BIGINT) g, CAST(event_id % 5 - 2 AS INTEGER) e, CAST(event_id % 4 - 2 AS HUGEINT) c FROM events)"


def big(df):
    return df.select("g", "e", F.col("coeff").cast("bigint").alias("coeff"))


def _rollup(spark, d):
    p = poly.clean(events_poly(spark, d, 7))
    return p.rollup("g", "e").agg(F.sum("coeff").cast("bigint").alias("coeff"), F.count("*").alias("terms")).select(F.coalesce("g", F.lit(-1)).alias("g"), F.coalesce("e", F.lit(-99)).alias("e"), "coeff", "terms")


def _layout(kind):
    def run(spark, d):
        n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("bigint").alias("g"), F.col("n_name").alias("label"))
        got = {"ngon": fam.ngon, "column": fam.column}.get(kind, fam.ngon)(n)
        got = fam.normalise(got, 2.0) if kind == "normalise" else got
        return got.select("g", "label", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))

    return run


NGON = f"l AS (SELECT CAST(n_regionkey AS BIGINT) g, n_name AS label, CASE WHEN n = 1 THEN 0.0 ELSE cos(pi() / 2 + 2 * pi() * k / n) END x, CASE WHEN n = 1 THEN 0.0 ELSE sin(pi() / 2 + 2 * pi() * k / n) END y, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 k, count(*) OVER (PARTITION BY n_regionkey) n FROM nation))"


def _sweep(spark, d):
    return fam.sweeps(spark, 10)


_IN = lambda lo, hi, c: f"(SELECT CAST(i AS INTEGER) {c} FROM range({lo}, {hi + 1}) t(i))"
_TWO = lambda name, a, b, order, holds="true": f"SELECT '{name}' family, list_value({order}) k, '(' || a || ', ' || b || ')' params FROM {_IN(*a, 'a')}, {_IN(*b, 'b')} WHERE {holds}"
_SIZES = " UNION ALL ".join(
    f"SELECT '{name}' family, list_value(a) k, '(' || a || ',)' params FROM {_IN(lo, lo + 9, 'a')}"
    for name, lo in (("periodic_theta", 1), ("complete_graph", 1), ("fan", 2), ("wheel", 3), ("ladder", 2), ("circular_ladder", 3), ("hypercube", 1), ("friendship", 1), ("mobius_ladder", 2))
)
_FIVE = "(SELECT unnest([0, 1, 2, 3, 4, 5]) {c})"
SWEEP = f"""WITH c AS ({_SIZES} UNION ALL {_TWO('sierpinski', (2, 13), (1, 7), 'a * b, b, a')} UNION ALL {_TWO('complete_bipartite', (1, 20), (1, 20), 'a + b, greatest(a, b), least(a, b)', 'b >= a')}
UNION ALL {_TWO('grid', (1, 10), (1, 12), 'a * b, a + b, a, b')} UNION ALL {_TWO('cylinder', (2, 10), (2, 12), 'a * b, a + b, a, b')} UNION ALL {_TWO('windmill', (3, 10), (2, 20), '1 + b * (a - 1), a + b, a, b')}
UNION ALL {_TWO('generalized_petersen', (5, 30), (1, 15), 'a, b', 'b < a / 2.0')}
UNION ALL SELECT 'complete_multipartite', [list_sum(p), len(p)] || p, '(' || array_to_string(p, ', ') || ')' FROM (SELECT list_filter([v, w, x, y, z], lambda n: n > 0) p FROM {', '.join(_FIVE.format(c=c) for c in 'vwxyz')} WHERE v >= w AND w >= x AND x >= y AND y >= z AND w > 0 AND v + w + x + y + z <= 10)
UNION ALL SELECT 'circulant', [a, len(j)] || j, '(' || a || ', (' || array_to_string(j, ', ') || CASE WHEN len(j) = 1 THEN ',))' ELSE '))' END FROM {_IN(4, 30, 'a')}, (SELECT unnest([[1], [2], [1, 2], [1, 3], [2, 3], [1, 4], [2, 4], [1, 2, 3]]) j) WHERE list_max(j) < a),
r AS (SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY k) AS INTEGER) AS rank, params FROM c) SELECT family, rank, params FROM r WHERE rank <= 10"""


def _coverage(spark, d):
    """Families with the number of rows in their sweep; 0 for the two that have none."""
    n = fam.sweeps(spark, 10).groupBy("family").agg(F.count("*").alias("rows"))
    return spark.createDataFrame([(x,) for x in fam.names()], "family string").join(n, "family", "left").select("family", F.coalesce("rows", F.lit(0)).alias("rows"))


def _written(spark, d):
    """The sweeps written as a dataset and read back."""
    path = f"{shared_dir(spark)}/family-dataset-{uuid.uuid4().hex}"
    return dataset.read(spark, dataset.write(_sweep(spark, d).select("family", "params"), path))


def _consensus(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    tries = e.select((F.col("user_id") % 50).cast("bigint").alias("g"), F.col("event_id").cast("bigint").alias("ord"), F.concat_ws(":", "event_type", (F.col("event_id") % 3)).alias("poly"))
    return poly.consensus(tries, 3)


CONSENSUS = "WITH t AS (SELECT CAST(user_id % 50 AS BIGINT) g, CAST(event_id AS BIGINT) ord, event_type || ':' || (event_id % 3) poly FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY g, poly ORDER BY ord) n FROM t), h AS (SELECT g, arg_min(poly, ord) poly, min(ord) found_at FROM r WHERE n = 3 GROUP BY g) SELECT g, coalesce(poly, '') AS poly, coalesce(found_at, -1) AS found_at, CASE WHEN found_at IS NULL THEN 'no_agreement' ELSE 'agreed' END AS status FROM (SELECT DISTINCT g FROM t) LEFT JOIN h USING (g)"


def plans():
    out = {f"family_{n}": family(n) for n in fam.FAMILIES}
    total = lambda t: f"SELECT g, e, sum(c) c FROM ({t}) GROUP BY g, e HAVING sum(c) <> 0"
    show = " SELECT g, e, CAST(c AS BIGINT) AS coeff FROM r"
    return out | {
        "layout_ngon": (_layout("ngon"), f"WITH {NGON} SELECT g, label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM l"),
        "layout_column": (_layout("column"), f"WITH {NGON} SELECT g, label, CAST(0 AS DOUBLE) AS x, CAST((n - 1) / 2.0 - k AS DOUBLE) AS y FROM l"),
        "normalize_layout": (_layout("normalise"), f"WITH {NGON}, b AS (SELECT *, min(x) OVER w x0, max(x) OVER w x1, min(y) OVER w y0, max(y) OVER w y1 FROM l WINDOW w AS (PARTITION BY g)) SELECT g, label, round((x - (x0 + x1) / 2) * 4 / greatest(x1 - x0, y1 - y0, 1.0), 6) + 0.0 AS x, round((y - (y0 + y1) / 2) * 4 / greatest(x1 - x0, y1 - y0, 1.0), 6) + 0.0 AS y FROM b"),
        "sweep_params": (_sweep, SWEEP),
        "sweep_coverage": (_coverage, "WITH n AS (SELECT unnest(['bouquet', 'theta', " + ", ".join(f"'{x}'" for x in sorted(set(TWINS) - {"bouquet", "theta"})) + "]) AS family) SELECT family, CASE WHEN family IN ('bouquet', 'theta') THEN 0 ELSE 10 END AS rows FROM n"),
        "dataset_sink": (_written, SWEEP.replace("SELECT family, rank, params FROM r", "SELECT family, params FROM r")),
        "poly_add": (lambda s, d: big(poly.add(events_poly(s, d, 7), events_poly(s, d, 4))), f"WITH {P}, r AS ({total('SELECT * FROM p UNION ALL SELECT * FROM q')})" + show),
        "poly_mul": (lambda s, d: big(poly.multiply(poly.clean(events_poly(s, d, 7)), poly.clean(events_poly(s, d, 4)))), f"WITH {P}, a AS ({total('SELECT * FROM p')}), b AS ({total('SELECT * FROM q')}), r AS ({total('SELECT a.g, a.e + b.e AS e, a.c * b.c AS c FROM a JOIN b USING (g)')})" + show),
        "poly_eq": (lambda s, d: poly.equal(events_poly(s, d, 7), poly.clean(events_poly(s, d, 7)).unionByName(s.createDataFrame([(3, 0, "1")], "g long, e int, coeff string").withColumn("coeff", F.col("coeff").cast(poly.EXACT)))), "SELECT DISTINCT CAST(user_id % 20 AS BIGINT) AS g, user_id % 20 <> 3 AS equal FROM events"),
        "normalize_poly": (lambda s, d: big(poly.normalise(poly.clean(events_poly(s, d, 7)))), f"WITH {P}, a AS ({total('SELECT * FROM p')}), l AS (SELECT g, min(e) low FROM a GROUP BY g), r AS (SELECT g, e - low AS e, CASE WHEN low % 2 = 0 THEN c ELSE -c END c FROM a JOIN l USING (g))" + show),
        "poly_rollup": (_rollup, f"WITH {P}, a AS ({total('SELECT * FROM p')}) SELECT coalesce(g, -1) AS g, coalesce(e, -99) AS e, CAST(sum(c) AS BIGINT) AS coeff, count(*) AS terms FROM a GROUP BY ROLLUP (g, e)"),
        "yamada_consensus": (_consensus, CONSENSUS),
        "negami": (_negami, SUBSETS + " SELECT g, removed, beta, mu, n FROM h"), "yamada_abstract": (_abstract, ABSTRACT), "yamada_sigma": (_sigma, None), "yamada_recursive": (_recursive, None),
        "laurent_to_sigma": (_back, None), "family_dataset": (_dataset, None), "yamada_states": (_states, None), "yamada_diagram": (_diagram(False), _known("0:1 1:1 2:1 3:1 4:1 5:1 6:1 7:1 8:1")), "yamada_diagram_compatible": (_diagram(True), _known("0:1 1:1 2:1 4:-1 5:-2 6:-2 7:-1")),
    }
