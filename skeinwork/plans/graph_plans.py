"""Queries of the multigraph operators on nation, supplier, order and event graphs, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import canonical, eccentricity, graphs
from .common import cut


def trade(spark, d):
    """(u, v): one edge per line item, customer nation to supplier nation. Dimension sides are pruned to two columns."""
    read = lambda t, *c: spark.read.parquet(f"{d}/{t}.parquet").select(*c)
    li = read("lineitem", "l_orderkey", "l_suppkey")
    cu = read("customer", "c_custkey", F.col("c_nationkey").alias("u"))
    o = read("orders", "o_orderkey", "o_custkey").join(cu, F.col("o_custkey") == F.col("c_custkey"))
    su = read("supplier", "s_suppkey", F.col("s_nationkey").alias("v"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))


TRADE = "mg AS (SELECT CAST(c_nationkey AS BIGINT) u, CAST(s_nationkey AS BIGINT) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


#: Edges of a pair that are numbered together.
RUN = 1 << 14


def whole(spark, d):
    """The trade multigraph, every line item an edge with an id: equal rows can't be told apart, so ids come from pairs and
    their counts. There are few pairs, whose rows would fit into one task; runs of their edges are dealt to all tasks."""
    n = trade(spark, d).groupBy("u", "v").agg(F.count("*").alias("n"))
    runs = n.select("u", "v", "n", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)")).alias("from"))
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u", "v", "from")
    rows = runs.select("u", "v", F.explode(F.expr(f"sequence(from, least(from + {RUN}, n) - 1)")).alias("k"))
    return rows.select(((F.col("u") * 1000 + F.col("v")) * 10**12 + F.col("k")).alias("eid"), "u", "v")


WHOLE = f"{TRADE}, e AS (SELECT (u * 1000 + v) * 1000000000000 + k AS eid, u, v FROM (SELECT u, v, unnest(range(n)) k FROM (SELECT u, v, count(*) n FROM mg GROUP BY u, v)))"


ENDS = "ends AS (SELECT eid, u AS v, v AS w FROM e UNION ALL SELECT eid, v, u FROM e), deg AS (SELECT v, count(*) AS degree FROM ends GROUP BY v)"
# components by repeated reach; graphs here have a few dozen vertices
REACH = "near AS (SELECT DISTINCT v, w FROM ends), reach AS (SELECT v, v AS w FROM deg UNION SELECT reach.v, near.w FROM reach JOIN near ON reach.w = near.v), comp AS (SELECT v, min(w) component FROM reach GROUP BY v)"


def walk(spark, d):
    """Transitions between the event types of a user in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return ev.select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b IS NOT NULL")


def _walk(spark, d):
    return walk(spark, d).groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("multiplicity"))


WALK = "SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS multiplicity FROM (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2"


def _canonical(spark, d):
    e = trade(spark, d).withColumn("eid", F.lit(0))
    return graphs.canonical(e).groupBy("u", "v").agg((F.max("k") + 1).cast("bigint").alias("parallel"))


def supply(spark, d):
    """The trade multigraph with every supplier hung on its nation as a leaf."""
    su = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 10**17).cast("bigint").alias("eid"), (F.col("s_suppkey") + 100000).cast("bigint").alias("u"), F.col("s_nationkey").cast("bigint").alias("v"))
    return whole(spark, d).unionByName(su)


def _prune(spark, d):
    return graphs.prune_leaves(supply(spark, d), cut).select("eid", "u", "v")


def prune_sql():
    # whatever is left after eight rounds has no leaves
    parts = [WHOLE, "p0 AS (SELECT * FROM e UNION ALL SELECT s_suppkey + 100000000000000000, s_suppkey + 100000, s_nationkey FROM supplier)"]
    for i in range(8):
        parts.append(f"d{i} AS (SELECT v FROM (SELECT u AS v FROM p{i} UNION ALL SELECT v FROM p{i}) GROUP BY v HAVING count(*) = 1), p{i + 1} AS (SELECT * FROM p{i} WHERE u NOT IN (SELECT v FROM d{i}) AND v NOT IN (SELECT v FROM d{i}))")
    return "WITH " + ", ".join(parts) + " SELECT eid, u, v FROM p8"


def forest(spark, d):
    """Region, nation, supplier as a forest with three kinds of vertices."""
    na = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1000).cast("bigint").alias("u"), F.col("n_regionkey").cast("bigint").alias("v"))
    su = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 100000).cast("bigint").alias("u"), (F.col("s_nationkey") + 1000).cast("bigint").alias("v"))
    return na.unionByName(su).withColumn("eid", F.col("u"))


FOREST = "e AS (SELECT u AS eid, u, v FROM (SELECT CAST(n_nationkey + 1000 AS BIGINT) u, CAST(n_regionkey AS BIGINT) v FROM nation UNION ALL SELECT CAST(s_suppkey + 100000 AS BIGINT), CAST(s_nationkey + 1000 AS BIGINT) FROM supplier))"


def orders_forest(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 10**9).cast("bigint").alias("u"), F.col("o_custkey").cast("bigint").alias("v"))
    return o.withColumn("eid", F.col("u"))


def part_supp(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").cast("bigint").alias("u"), (F.col("l_suppkey") + 10**9).cast("bigint").alias("v")).distinct()
    return li.withColumn("eid", F.xxhash64("u", "v"))


def _chains(spark, d):
    got = graphs.chains(graphs.prune_leaves(forest_ring(spark, d), cut), cut)
    return got.select("u", "v", "edges")


def forest_ring(spark, d):
    """The trade multigraph with every edge cut in two by a vertex of its own, so that it has chains."""
    e = whole(spark, d)
    mid = (F.col("eid") + 10**17).alias("m")
    return e.select((2 * F.col("eid")).alias("eid"), "u", mid.alias("v")).unionByName(e.select((2 * F.col("eid") + 1).alias("eid"), mid.alias("u"), "v"))


def _summary(spark, d):
    e = cut(whole(spark, d))
    s, c = graphs.summary(e), graphs.cycle_rank(e, cut)
    return s.join(c.select("components", "rank")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("property"), F.col(k).cast("bigint").alias("value")) for k in ("nodes", "edges", "loops", "max_multiplicity", "components", "rank")])).alias("x")).select("x.*")


SUMMARY_CTE = "s AS (SELECT (SELECT count(*) FROM deg) nodes, (SELECT count(*) FROM e) edges, (SELECT count(*) FROM e WHERE u = v) loops, (SELECT max(n) FROM (SELECT count(*) n FROM e GROUP BY least(u, v), greatest(u, v))) max_multiplicity, (SELECT count(DISTINCT component) FROM comp) components)"


def _positions(spark, d):
    """Places of nations by their customers' balances, for edge lengths."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.groupBy(F.col("c_nationkey").cast("bigint").alias("v")).agg(F.round(F.avg("c_acctbal"), 2).alias("x"), F.round(F.min("c_acctbal"), 2).alias("y"), F.round(F.max("c_acctbal"), 2).alias("z"))


def _short(spark, d):
    return graphs.shortest(whole(spark, d), _positions(spark, d), 1e9).select("eid", "u", "v", (F.round("length", 4) + 0.0).alias("length"), "keep")


SHORT = f"WITH {WHOLE}, {ENDS}, pos AS (SELECT CAST(c_nationkey AS BIGINT) v, round(avg(c_acctbal), 2) x, round(min(c_acctbal), 2) y, round(max(c_acctbal), 2) z FROM customer GROUP BY 1), l AS (SELECT eid, e.u, e.v, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS length, a.degree da, b.degree db FROM e JOIN pos p ON p.v = e.u JOIN pos q ON q.v = e.v JOIN deg a ON a.v = e.u JOIN deg b ON b.v = e.v WHERE e.u <> e.v) SELECT eid, u, v, round(length, 4) + 0.0 AS length, CASE WHEN da > db OR (da = db AND CAST(u AS VARCHAR) <= CAST(v AS VARCHAR)) THEN u ELSE v END AS keep FROM l ORDER BY length, eid LIMIT 1"


def _contract(spark, d):
    e = cut(whole(spark, d))
    return graphs.contract(e, graphs.pick_edge(e).first()["eid"])


def _delete(spark, d):
    e = cut(whole(spark, d))
    return graphs.delete(e, graphs.pick_edge(e).first()["eid"])


def _minor(spark, d):
    """Whether K3 and K4 are minors of small graphs: each nation's neighbourhood in the trade graph."""
    from ..operators.kernels import minors

    e = cut(whole(spark, d))
    near = graphs.ends(e).select(F.col("v").alias("graph_id"), F.col("w").alias("x")).where("graph_id <> x").distinct()
    a, b = near.select("graph_id", F.col("x").alias("u")), near.select("graph_id", F.col("x").alias("v"))
    sub = graphs.simple(e).join(a, "u").join(b, ["graph_id", "v"]).select("graph_id", "u", "v")
    return minors(sub, {"k3": 3, "k4": 4})


def _wl(spark, d):
    return graphs.wl_key(graphs.wl_hash(whole(spark, d)))


def wl_sql():
    sql = f"WITH {WHOLE}, sp AS (SELECT DISTINCT least(u, v) u, greatest(u, v) v FROM e WHERE u <> v), nb AS (SELECT u, v FROM sp UNION ALL SELECT v, u FROM sp), l0 AS (SELECT u AS v, CAST(count(*) AS VARCHAR) label FROM nb GROUP BY u)"
    for i in range(3):
        sql += f", t{i} AS (SELECT nb.u, string_agg(l.label, ',' ORDER BY l.label) around FROM nb JOIN l{i} l ON l.v = nb.v GROUP BY nb.u), l{i + 1} AS (SELECT l.v, md5(l.label || '|' || t.around) label FROM l{i} l JOIN t{i} t ON t.u = l.v)"
    return sql + ", c AS (SELECT label || ':' || count(*) s FROM l3 GROUP BY label) SELECT md5(string_agg(s, ';' ORDER BY s)) AS wl_hash FROM c"


LABEL = f"WITH {WHOLE}, i AS (SELECT v AS x, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) - 1 AS id FROM (SELECT u AS v FROM e UNION SELECT v FROM e)), p AS (SELECT least(a.id, b.id) a, greatest(a.id, b.id) b FROM e JOIN i a ON a.x = e.u JOIN i b ON b.x = e.v)"
CANON = f"WITH {WHOLE}, {ENDS}, lo AS (SELECT u AS v, count(*) loops FROM e WHERE u = v GROUP BY u), ar AS (SELECT ends.v, string_agg(lpad(CAST(d.degree AS VARCHAR), 19, '0'), ',' ORDER BY d.degree) around FROM ends JOIN deg d ON d.v = ends.w GROUP BY ends.v), i AS (SELECT deg.v AS x, row_number() OVER (ORDER BY degree, coalesce(loops, 0), around, deg.v) - 1 AS id FROM deg LEFT JOIN lo ON lo.v = deg.v JOIN ar ON ar.v = deg.v), p AS (SELECT least(a.id, b.id) a, greatest(a.id, b.id) b FROM e JOIN i a ON a.x = e.u JOIN i b ON b.x = e.v)"
LIST = "string_agg(a || '-' || b, ',' ORDER BY a, b)"
DIST = f"WITH RECURSIVE {WHOLE}, nb AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), vs AS (SELECT DISTINCT u FROM nb), bf AS (SELECT u AS src, u AS dst, 0 AS d FROM vs UNION SELECT src, nb.v, d + 1 FROM bf JOIN nb ON nb.u = bf.dst WHERE d < 12), di AS (SELECT src, dst, min(d) d FROM bf GROUP BY src, dst), n AS (SELECT count(*) n FROM (SELECT u FROM e UNION SELECT v FROM e))"
PICK = f"WITH {WHOLE}, pick AS (SELECT * FROM e WHERE u <> v ORDER BY eid LIMIT 1)"


def months(spark, d):
    """A multigraph for each customer: from the month of an order to that of the next one."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("graph_id"), F.month("o_orderdate").alias("u"), "o_orderdate", "o_orderkey")
    w = Window.partitionBy("graph_id").orderBy("o_orderdate", "o_orderkey")
    return o.select("graph_id", "u", F.lead("u").over(w).alias("v")).where("v IS NOT NULL")


def _classes(spark, d):
    """How many customers' graphs are the same but for the names of the months, by the least customer of each class."""
    got = canonical.keys(months(spark, d))
    return got.groupBy("n", "canonical_key").agg(F.count("*").alias("graphs"), F.min("graph_id").alias("least"))


def meetings(spark, d):
    """Customers and the dates of their orders, dates below zero."""
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("bigint").alias("u"), (-F.unix_date(F.col("o_orderdate").cast("date")) - 1).cast("bigint").alias("v"))


# reach of all vertices as bit strings, a level at a time: the diameter is the first level at which all are full
LEVELS = 16
MEETINGS = (
    "WITH g AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) u, CAST(-date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 1 AS BIGINT) v FROM orders), "
    "i AS MATERIALIZED (SELECT x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) i FROM (SELECT u x FROM g UNION SELECT v FROM g)), n AS (SELECT CAST(count(*) AS INTEGER) n FROM i), "
    "nb AS MATERIALIZED (SELECT a.i a, b.i b FROM g JOIN i a ON a.x = g.u JOIN i b ON b.x = g.v UNION SELECT b.i, a.i FROM g JOIN i a ON a.x = g.u JOIN i b ON b.x = g.v UNION SELECT i, i FROM i), "
    "b0 AS MATERIALIZED (SELECT i, set_bit(CAST(repeat('0', n) AS BIT), i, 1) s FROM i, n)"
    + "".join(f", b{k} AS MATERIALIZED (SELECT nb.a AS i, bit_or(s) s FROM nb JOIN b{k - 1} ON b{k - 1}.i = nb.b GROUP BY nb.a)" for k in range(1, LEVELS + 1))
    + ", f AS (" + " UNION ALL ".join(f"SELECT {k} k, min(bit_count(s)) = max(n) AS full_ FROM b{k}, n" for k in range(LEVELS + 1))
    + ") SELECT (SELECT CAST(n AS BIGINT) FROM n) AS vertices, bool_or(full_) AS is_connected, CAST(min(k) FILTER (full_) AS BIGINT) AS diameter FROM f"
)


def plans():
    comp = f"WITH RECURSIVE {WHOLE}, {ENDS}, {REACH}"
    return {
        "graph_counts": (lambda s, d: graphs.summary(part_supp(s, d)).select("nodes", "edges"), "WITH e AS (SELECT DISTINCT l_partkey u, l_suppkey + 1000000000 v FROM lineitem) SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges"),
        "canonical_edges": (_canonical, f"WITH {TRADE} SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS parallel FROM mg GROUP BY 1, 2"),
        "simple_graph": (lambda s, d: graphs.simple(trade(s, d)), f"WITH {TRADE} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM mg WHERE u <> v"),
        "event_transitions": (_walk, WALK),
        "degree_hist": (lambda s, d: graphs.degree_histogram(part_supp(s, d)), "WITH e AS (SELECT DISTINCT l_partkey u, l_suppkey + 1000000000 v FROM lineitem), dg AS (SELECT x, count(*) AS degree FROM (SELECT u x FROM e UNION ALL SELECT v FROM e) GROUP BY x) SELECT degree, count(*) AS nodes FROM dg GROUP BY degree"),
        "multigraph_summary": (lambda s, d: graphs.summary(trade(s, d)), f"WITH {TRADE} SELECT (SELECT count(*) FROM (SELECT u FROM mg UNION SELECT v FROM mg)) AS nodes, (SELECT count(*) FROM mg) AS edges, (SELECT count(*) FROM mg WHERE u = v) AS loops, (SELECT max(n) FROM (SELECT count(*) n FROM mg GROUP BY least(u, v), greatest(u, v))) AS max_multiplicity"),
        "graph_summary": (_summary, comp + f", {SUMMARY_CTE} SELECT unnest(['nodes', 'edges', 'loops', 'max_multiplicity', 'components', 'rank']) AS property, unnest([nodes, edges, loops, max_multiplicity, components, edges - nodes + components]) AS value FROM s"),
        "components": (lambda s, d: graphs.connected(orders_forest(s, d), cut).groupBy("component").agg(F.count("*").alias("vertices")), "SELECT CAST(o_custkey AS BIGINT) AS component, count(*) + 1 AS vertices FROM orders GROUP BY o_custkey"),
        "forest_components": (lambda s, d: graphs.connected(forest(s, d), cut), f"WITH RECURSIVE {FOREST}, {ENDS}, r AS (SELECT v, v AS root FROM deg WHERE v < 1000 UNION ALL SELECT ends.v, r.root FROM r JOIN ends ON ends.w = r.v WHERE ends.v > r.v) SELECT v, root AS component FROM r"),
        "has_cycle": (lambda s, d: graphs.cycle_rank(cut(whole(s, d)), cut).select("vertices", "edges", "components", "has_cycle"), comp + " SELECT count(*) AS vertices, (SELECT count(*) FROM e) AS edges, count(DISTINCT component) AS components, (SELECT count(*) FROM e) - count(*) + count(DISTINCT component) > 0 AS has_cycle FROM comp"),
        "is_trivalent": (lambda s, d: graphs.is_trivalent(whole(s, d)), f"WITH {WHOLE}, {ENDS} SELECT max(degree) <= 3 AS is_trivalent FROM deg"),
        "prune_leaves": (_prune, prune_sql()),
        "contract_chains": (_chains, f"WITH {WHOLE} SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(2 AS BIGINT) AS edges FROM e"),
        "simplify_edges": (lambda s, d: graphs.simplify(forest_ring(s, d), cut), f"WITH {WHOLE}, {ENDS}, i AS (SELECT v AS x, row_number() OVER (ORDER BY v) - 1 AS id FROM deg) SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, CAST(2 AS BIGINT) AS edges FROM e JOIN i a ON a.x = e.u JOIN i b ON b.x = e.v"),
        "diameter_avgpath": (lambda s, d: graphs.diameter(cut(whole(s, d)), cut).select("is_connected", "diameter", (F.round("average_path", 6) + 0.0).alias("average_path")), DIST + " SELECT count(*) = max(n) * max(n) AS is_connected, CASE WHEN count(*) = max(n) * max(n) THEN CAST(max(d) AS BIGINT) END AS diameter, CASE WHEN count(*) = max(n) * max(n) THEN round(CAST(sum(d) AS DOUBLE) / (max(n) * (max(n) - 1)), 6) + 0.0 END AS average_path FROM di, n"),
        "diameter_by_bounds": (lambda s, d: eccentricity.diameter(meetings(s, d), cut), MEETINGS),
        "wl_hash": (_wl, wl_sql()),
        "label_key": (lambda s, d: graphs.label_key(whole(s, d), cut), LABEL + f" SELECT (SELECT count(*) FROM i) AS n, {LIST} AS edge_list FROM p"),
        "canonical_key": (lambda s, d: graphs.canonical_key(whole(s, d), cut), CANON + f" SELECT (SELECT count(*) FROM i) AS n, sha256((SELECT count(*) FROM i) || '|' || {LIST}) AS canonical_key FROM p"),
        "canonical_classes": (_classes, None),
        "pick_edge": (lambda s, d: graphs.pick_edge(whole(s, d)), PICK + " SELECT eid, u, v FROM pick"),
        "edge_delete": (_delete, PICK + " SELECT eid, u, v FROM e WHERE eid <> (SELECT eid FROM pick)"),
        "edge_contract": (_contract, PICK + ", g AS (SELECT greatest(u, v) gone, least(u, v) keep FROM pick) SELECT eid, CASE WHEN u = gone THEN keep ELSE u END AS u, CASE WHEN v = gone THEN keep ELSE v END AS v FROM e, g WHERE eid <> (SELECT eid FROM pick)"),
        "minor_k3": (lambda s, d: graphs.cycle_rank(graphs.simple(whole(s, d)).withColumn("eid", F.xxhash64("u", "v")), cut).select(F.col("has_cycle").alias("has_k3_minor")), comp + ", sg AS (SELECT DISTINCT least(u, v) u, greatest(u, v) v FROM e WHERE u <> v) SELECT (SELECT count(*) FROM sg) - count(*) + count(DISTINCT component) > 0 AS has_k3_minor FROM comp"),
        "minor": (_minor, None),
        "contract_short_step": (_short, SHORT),
    }
