"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measures of the whole text from DataFrame functions. Training is cyclic boosting: in each round every
feature in turn gets a shallow tree on its bins, whose leaf values are added to the feature's lookup table; afterwards
the pairs of features that explain most of what is left get two-dimensional tables the same way. A score is the intercept
and one table entry per feature and pair, added up for a whole Arrow batch at once.

Training reads about SAMPLE labelled rows (those with the smallest hashes, any fold but the held-out one); scoring covers
every row. Labels, lang, source and doc_id are no inputs of a score. Null and empty texts have all measures 0 and are
scored like others, as are rows without a doc_id, which are in no fold; equal texts have equal scores. Without labels of
both kinds every score is the smoothed share. Extra columns aren't read.

Texts are taken whole, however long; features are ratios and counts over all of a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stage, table
from .quality import with_measures

#: Labelled rows that training may use.
SAMPLE = 40_000
BINS, PAIR_BINS, PAIRS = 32, 6, 3
#: feature: SQL over the columns of quality.with_measures.
FEATURES = {
    "words": "ln(1 + q_n_words)",
    "length": "q_length / 1000",
    "symbols": "q_symbols / 1e6",
    "dup_lines": "q_dup_lines / 1e6",
    "repeats": "q_repeats / 1e6",
    "capitals": "q_capitals / 1e6",
    "line_words": "ln(1 + q_n_words / greatest(1, q_n_lines))",
    "marks": "x_marks / greatest(1, q_word_chars)",
    "digits": "x_digits / greatest(1, q_word_chars)",
    "common": "x_common / greatest(1, q_n_words)",
}


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row of docs(doc_id, text), one pass over the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    gone = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    rows = with_measures(rows.select("doc_id", "text")).withColumns({
        "x_marks": gone("!?\"'()[]{}=_/\\~^@+;:"), "x_digits": gone("0123456789"),
        # places where a common short word stands between spaces
        "x_common": F.size(F.split(F.lower(text), r" (?:the|of|and|to|in|is|de|la|le|et|les|que|der|die|und|den|el|en|y|un|das|a) ")) - 1,
    })
    return rows.select("doc_id", *[F.expr(f"cast({sql} as double)").alias(f"f_{k}") for k, sql in FEATURES.items()])


@dataclass
class Additive:
    """Cuts between the bins of each feature, its table, and tables of pairs with coarser cuts."""

    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins with gradient sums g and curvature sums h."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.concatenate([_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, depth: int = 2, ridge: float = 2.0) -> Additive:
    """A model of y (0 or 1) by the columns of x. Without both labels it is the constant share, smoothed."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    cuts = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    model = Additive(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            step = rate * _tree(np.bincount(at[k], y - p, len(t)), np.bincount(at[k], p * (1 - p), len(t)), depth, ridge)
            t += step
            margin += step[at[k]]
    for k, t in enumerate(model.tables):  # centre the tables
        mean = float(np.mean(t[at[k]]))
        t -= mean
        model.intercept += mean
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    width = [len(c) + 1 for c in model.pair_cuts]
    cell = lambda a, b: coarse[a] * width[b] + coarse[b]
    p = 1 / (1 + np.exp(-margin))
    left = []
    for a in range(len(cuts)):
        for b in range(a + 1, len(cuts)):
            g, h = np.bincount(cell(a, b), y - p, width[a] * width[b]), np.bincount(cell(a, b), p * (1 - p), width[a] * width[b])
            left.append((-float((g * g / (h + 10 * ridge)).sum()), a, b))
    model.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in sorted(left)[:PAIRS]]
    for _ in range(rounds // 4):
        for a, b, t in model.pairs:
            p = 1 / (1 + np.exp(-margin))
            g = np.bincount(cell(a, b), y - p, t.size).reshape(t.shape)
            h = np.bincount(cell(a, b), p * (1 - p), t.size).reshape(t.shape)
            # a cut along one feature, then one along the other within each side
            rows = _tree(g.sum(1), h.sum(1), 1, ridge)
            side = rows != rows[0]
            step = np.zeros_like(t)
            for s in (side, ~side):
                if s.any():
                    step[s] = _tree(g[s].sum(0), h[s].sum(0), 1, 5 * ridge)
            t += rate * step
            margin += rate * step[coarse[a], coarse[b]]
    return model


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model from rows of featured() and labels(doc_id, quality), without the held-out fold."""
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    inputs = [f"f_{k}" for k in FEATURES]
    known = stage(rows.where(~held_out()).join(marks, "doc_id").select("doc_id", "y", *inputs), "additive-labelled")
    known = bounded(known, F.xxhash64("doc_id", *inputs), sample)
    got = known.select("y", *inputs, F.xxhash64("doc_id").alias("turn")).toPandas().sort_values(["turn", "y", *inputs])
    return fit(got[inputs].to_numpy(float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(rows: DataFrame, model: Additive) -> DataFrame:
    """rows of featured() with score."""

    @F.pandas_udf("double")
    def of(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x.to_numpy(float)))

    return rows.withColumn("score", of(F.struct(*[f"f_{k}" for k in FEATURES])))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op3: one row per document."""
    rows = stage(featured(table(spark, sf_dir, "documents").select("doc_id", "text")), "additive-features")
    got = scored(rows, train(rows, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
