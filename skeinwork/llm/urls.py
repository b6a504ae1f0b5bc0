"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs by DataFrame aggregation alone: every feature is a small integer bin, one level
of one tree is one aggregate of gradients by (node, feature, bin), which has at most NODES * features * BINS rows
whatever the input, and the driver only picks splits from it. Scoring is a sum of CASE expressions over the bins.
Training uses about `sample` distinct labelled URLs (those with the smallest hashes); scoring covers every row.

Null urls and urls without :// have an empty host and path, match no rule, and are scored like the others. Rows that
repeat, or have no page_id, are each judged; an empty table gives an empty result, and without labels of both kinds the
score is the same for all.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, stage, table

#: Rules of the query: (verdict, host and path); a fixed list.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
# Parts of host names that label a URL as bad for training.
SEEDS = frozenset("adult ads banner bet bets betting bingo casino cialis click clickbait escort fake gambling hack jackpot loan loans malware phishing pills poker porn scam sex slots spam tracker track viagra warez xxx".split())
BINS = 16
#: Labelled URLs that training may use.
SAMPLE = 20_000
#: feature: (width of a bin, SQL over the columns of _parts).
FEATURES = {
    "length": (12, "length(u)"),
    "host_length": (4, "length(host)"),
    "depth": (1, "length(path) - length(replace(path, '/', ''))"),
    "labels": (1, "size(split(host, '[.]'))"),
    "hyphens": (1, "length(host) - length(replace(host, '-', ''))"),
    "digits": (4, "coalesce(100 * (length(u) - length(regexp_replace(u, '[0-9]', ''))) div nullif(length(u), 0), 0)"),
    "host_digits": (1, "length(host) - length(regexp_replace(host, '[0-9]', ''))"),
    "parameters": (1, "length(query) - length(replace(query, '=', ''))"),
    "escapes": (1, "length(u) - length(replace(u, '%', ''))"),
    "secure": (1, "CASE WHEN u LIKE 'https:%' THEN 1 ELSE 0 END"),
    "entropy": (2, "cast(10 * entropy as int)"),
    "suffix": (6, "cast(100 * suffix_rate as int)"),
}


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    """df (with url, host, path) and u, query, entropy in bits of a character, and suffix (the last host label)."""
    df = df.withColumn("u", F.coalesce("url", F.lit(""))).withColumn("query", F.regexp_extract("u", r"[?]([^#]*)", 1))
    n = F.length("u").cast("double")
    logs = F.transform(F.array_distinct(F.split("u", "")), lambda c: n - F.length(F.replace(F.col("u"), c, F.lit(""))))
    spread = F.aggregate(logs, F.lit(0.0), lambda a, k: a + F.when(k > 0, k * F.log2(k)).otherwise(0.0))
    return df.withColumn("entropy", F.when(n > 0, F.log2(n) - spread / n).otherwise(0.0)).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))


def _binned(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(f"cast(greatest(0, least({BINS - 1}, ({sql}) div {width})) as int)").alias(f"f_{k}") for k, (width, sql) in FEATURES.items()])


@dataclass
class UrlModel:
    """Trees as nested tuples ((feature, bin, left, right) or a leaf value), and the suffix statistics."""

    base: float
    suffixes: dict[str, float]
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        def of(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.col(f"f_{t[0]}") <= t[1], of(t[2])).otherwise(of(t[3]))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total

    def with_rates(self, df: DataFrame) -> DataFrame:
        """suffix_rate: the smoothed share of bad URLs under the suffix; the share of all where it wasn't seen. The table
        has at most SAMPLE rows."""
        rates = df.sparkSession.createDataFrame(sorted(self.suffixes.items()) or [("", 0.0)], "suffix string, suffix_rate double")
        got = df.join(F.broadcast(rates), "suffix", "left")
        return got.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.suffixes.get(None, 0.0))))

    def score(self, df: DataFrame) -> DataFrame:
        """df (with url, host, path) and score: the probability that the url is bad."""
        keep = df.columns
        got = _binned(self.with_rates(_lexical(df)))
        return got.select(*keep, (1 / (1 + F.exp(-self.margin()))).alias("score"))


def fit(labelled: DataFrame, trees: int = 12, rate: float = 0.3, ridge: float = 1.0, least: int = 3, sample: int = SAMPLE) -> UrlModel:
    """Trees of depth two from (url, host, path, bad 0/1). Without rows of both kinds the model is a constant."""
    # a URL that is repeated counts once, however many pages have it
    known = labelled.where(F.col("bad").isNotNull()).groupBy("url", "host", "path").agg(F.max("bad").alias("bad"))
    rows = stage(_lexical(bounded(stage(known, "url-labels"), F.xxhash64("url"), sample)), "url-sample")
    n, bad = rows.agg(F.count("*"), F.sum("bad")).first()
    bad = bad or 0
    share = (bad + 0.5) / (n + 1)
    model = UrlModel(math.log(share / (1 - share)), {})
    if not 0 < bad < n:
        return model
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).collect()  # at most `sample` rows
    model.suffixes = {r["suffix"]: (r["bad"] + 20 * share) / (r["n"] + 20) for r in stats} | {"": share}
    binned = _binned(model.with_rates(rows))
    same = [f"f_{k}" for k in FEATURES]
    data = stage(binned.groupBy(*same).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).coalesce(4), "url-bins")

    def level(node: Column) -> dict:
        p = 1 / (1 + F.exp(-model.margin()))
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f_{k}").alias("b")) for k in FEATURES]))
        got = data.select(node.alias("node"), (F.col("bad") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), "n", cells.alias("c"))
        out: dict = {}
        for r in got.groupBy("node", "c.k", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            out.setdefault(r["node"], {}).setdefault(r["k"], {})[r["b"]] = (r["g"], r["h"], r["n"])
        return out

    def leaf(g: float, h: float) -> float:
        return float(rate * g / (h + ridge))

    def split(cells: dict) -> tuple | None:
        """(gain, feature, bin, left g h, right g h) of the best split; ties go to the first feature and bin."""
        best = None
        for k in FEATURES:
            own = cells.get(k, {})
            g, h, m = (sum(x[i] for x in own.values()) for i in range(3))
            a = b = c = 0.0
            for cut in sorted(own)[:-1]:
                a, b, c = a + own[cut][0], b + own[cut][1], c + own[cut][2]
                if min(c, m - c) >= least:
                    gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, k, cut, (a, b), (g - a, h - b))
        return best

    for _ in range(trees):
        top = split(level(F.lit(0)).get(0, {}))
        if not top:
            break
        below = level((F.col(f"f_{top[1]}") > top[2]).cast("int"))
        sides = []
        for side, sums in ((0, top[3]), (1, top[4])):
            deep = split(below.get(side, {}))
            sides.append((deep[1], deep[2], leaf(*deep[3]), leaf(*deep[4])) if deep else leaf(*sums))
        model.trees.append((top[1], top[2], *sides))
    return model


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, limit: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict, score: the longest rule decides, else a score over `limit` blocks. Where a
    column of pages is called like a new one, the new one gets a name with _ after it."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.struct("*").alias("row"), "url").withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = model.score(rows).withColumns({"rule": rule, "says": says})
    scored = scored.withColumn("verdict", F.coalesce("says", F.when(F.col("score") > limit, "block").otherwise("allow")))
    return scored.select("row.*", *[F.col(c).alias(free_name(pages, c)) for c in ("host", "path", "rule", "verdict", "score")])


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, host, path, bad): bad where a part of the host is one of SEEDS; else good where the page's document, named
    by the number that ends the path, is marked as of good quality. Other urls have no label."""
    host, path = parts(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("doc_id", F.try_to_number(F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("999999999999999999")).cast("long"))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("good_id")).distinct()
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.lit(sorted(SEEDS)))
    rows = rows.join(good, F.col("doc_id") == F.col("good_id"), "left").withColumn("bad", F.when(seeded, 1).when(F.col("good_id").isNotNull(), 0))
    return rows.where(F.col("bad").isNotNull()).select("url", "host", "path", F.col("bad").cast("long").alias("bad"))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op9: one row per page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = fit(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return filter_urls(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
