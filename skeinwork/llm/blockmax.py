"""Exact top-k search by inner product, a block of documents at a time.

Index: vectors go to the nearest of a few pivots (a bounded sample; it decides on the order only) and are cut into blocks of
BLOCK rows, a range of vec_ids each. A block is one row: the least and greatest value of every component, the block's term
maxima, and its forward index, the vectors themselves. Hot vectors fill many blocks, and no task gathers more than one.

Search: queries are taken in slices of about SLICE, so what is broadcast is bounded by that whatever the table's size. A
task reads blocks in batches. For each query it orders a batch's blocks by the bound that their term maxima sum up to,
and scores them through the forward index until the bound falls below the query's kth score so far. That starts with the
kth score in the query's own block, which was worked out with the index, so most tasks have a good one from the start.
Tasks return k rows a query at most, of which the best k are taken. Blocks whose bound equals the kth score are scored
too, so ties go to the smaller vec_id exactly. Work grows as queries times blocks that survive; on vectors that point in
all directions alike, bounds of single components are loose and nearly all blocks do.

Scores are exact: in floating point where all sums are below 2^53, else by Python integers; a score that no long can hold
counts as the nearest long. Null vectors and those with null or non-finite entries take no part, nor do vectors of another
length than most have (the longer of two lengths that are as common). Scaled entries beyond 9.2e18 count as that. A row is
its own candidate never, but rows that repeat, or share its vec_id, are; each such row is a query too. Null vec_ids are never
queries and come last among ties. An empty table, or one without queries, gives an empty result. Columns other than vec_id
and embedding aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stage
from .vectors import integers, matrix, prevailing

#: Rows of a block and of a task that makes blocks, both at most; blocks of a batch in the search.
BLOCK, TASK, BATCH = 1024, 1 << 16, 32
#: Queries that are broadcast at once, about: their vectors take 8 bytes a component.
SLICE = 1 << 15
#: Pivots at most, and rows they are taken from.
PIVOTS, SAMPLE = 256, 4096
LONG = 2**63 - 1
NEVER = -math.inf
BLOCKS = "block long, n int, vec_ids array<long>, low array<long>, high array<long>, vectors binary, asks array<int>, floors array<double>"


def _kind(length: int, largest: int) -> type:
    """float where scores and their places within a block are exact in it, else Python integers."""
    return float if max(1, length) * max(1, largest) ** 2 * BLOCK < 2**53 else object


def _width(largest: int) -> str:
    return next(w for w, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**64)) if largest < most)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as longs can hold them."""
    return scores if scores.dtype != object else np.minimum(np.maximum(scores, -LONG - 1), LONG)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places (k or fewer, columns) of the greatest scores of every column of a block, the smaller place first among equals."""
    n = len(scores)
    key = scores * BLOCK + np.arange(n - 1, -1, -1)[:, None]
    if scores.dtype != object and n > k:
        at = np.argpartition(-key, k - 1, axis=0)[:k]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 0), axis=0), 0)
    return np.argsort(-key, axis=0, kind="stable")[:k]


def _cut(length: int, width: str, kind: type, k: int, most: int):
    """Kernel: rows (pivot, vec_id, ask, v), ordered by pivot and vec_id, as blocks. floors: the kth score of each query
    (ask) in its block, its own row left out."""

    def block(number: int, ids: list, ask: np.ndarray, v: np.ndarray) -> tuple:
        asks = np.flatnonzero(ask)
        floors = np.full(len(asks), NEVER)
        if len(asks) and len(v) > k:
            w = v.astype(kind)
            scores = _held(w @ w[asks].T)
            scores[asks, np.arange(len(asks))] = NEVER
            floors = np.sort(scores, axis=0)[-k].astype(float)
            if kind is object:  # as floats they could be too high
                floors = np.where(np.isfinite(floors), floors - np.abs(floors) * 1e-9 - 1, floors)
        return number, len(v), ids, v.min(0).tolist(), v.max(0).tolist(), v.astype(width).tobytes(), asks.tolist(), floors.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, pivots, ask, v = 0, [], np.zeros(0, np.int32), np.zeros(0, bool), np.zeros((0, length), np.int64)

        def give(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24

        def take(last: bool) -> list[tuple]:
            nonlocal made, ids, pivots, ask, v
            out, at = [], 0
            while at < len(ids):
                end = min(at + most, at + int(np.searchsorted(pivots[at:], pivots[at], "right")))
                if end == len(ids) and end - at < most and not last:
                    break
                out.append(block(first + made, ids[at:end], ask[at:end], v[at:end]))
                made, at = made + 1, end
            ids, pivots, ask, v = ids[at:], pivots[at:], ask[at:], v[at:]
            return out

        for batch in batches:
            ids = ids + batch.column("vec_id").to_pylist()
            pivots = np.r_[pivots, batch.column("pivot").to_numpy(zero_copy_only=False)]
            ask = np.r_[ask, batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)]
            v = np.r_[v, matrix(batch.column("v"), length)]
            yield give(take(False))
        yield give(take(True))

    return run


def index(rows: DataFrame, length: int, n: int, largest: int, k: int, block: int) -> DataFrame:
    """The blocks of rows(vec_id, ask, v), n of them; see the module."""
    some = bounded(rows.select("v", F.xxhash64("v", "vec_id").alias("h")), F.col("h"), SAMPLE).orderBy("h").limit(max(1, min(PIVOTS, n // (4 * block)))).collect()
    pivots = np.array([r["v"] for r in some], float).reshape(len(some), length)
    norms = (pivots**2).sum(1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), length).astype(float)
            at = (norms - 2 * (v @ pivots.T)).argmin(1) if len(pivots) else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["pivot", *batch.schema.names])

    dealt = rows.select("vec_id", "ask", "v").mapInArrow(nearest, "pivot int, vec_id long, ask boolean, v array<bigint>")
    tasks = max(1, math.ceil(n / TASK), min(math.ceil(n / block), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    # the hash splits rows that have a vec_id, or none, in common
    order = [F.col("pivot"), F.col("vec_id").asc_nulls_last()]
    dealt = dealt.repartitionByRange(tasks, *order, F.xxhash64("v")).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(_cut(length, _width(largest), _kind(length, largest), k, block), BLOCKS), "topk-blocks")


def _asks(length: int, width: str):
    """Kernel: the queries of blocks: (uid, query_id, floor, v); a uid is a block and a place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                v = np.frombuffer(b["vectors"], width).reshape(b["n"], length)
                rows += [(b["block"] * BLOCK + i, b["vec_ids"][i], floor, v[i].astype("<i8").tobytes()) for i, floor in zip(b["asks"], b["floors"])]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.binary()))], ["uid", "query_id", "floor", "v"])

    return run


class Found:
    """The k best candidates of many queries so far: scores, vec_ids and whether these are null, best first."""

    def __init__(self, q: np.ndarray, floors: np.ndarray, uids: np.ndarray, k: int) -> None:
        self.q, self.uids, self.k = q, uids, k
        self.kth = floors.astype(q.dtype)
        self.score = np.full((len(q), k), NEVER, q.dtype)
        self.id = np.zeros((len(q), k), np.int64)
        self.null = np.zeros((len(q), k), bool)

    def offer(self, at: np.ndarray, block: int, ids: np.ndarray, null: np.ndarray, v: np.ndarray) -> None:
        """Score a block, whose rows are ordered by vec_id, for the queries `at`."""
        scores = _held(v @ self.q[at].T)
        own = np.flatnonzero(self.uids[at] // BLOCK == block)
        scores[self.uids[at[own]] % BLOCK, own] = NEVER
        best = _best(scores, self.k)
        s = np.take_along_axis(scores, best, 0).T
        s = np.where(s >= self.kth[at][:, None], s, NEVER).astype(scores.dtype)
        s, i, o = np.hstack([self.score[at], s]), np.hstack([self.id[at], ids[best].T]), np.hstack([self.null[at], null[best].T])
        if s.dtype == object:
            order = np.array([sorted(range(s.shape[1]), key=lambda c: (-s[r, c], o[r, c], i[r, c])) for r in range(len(s))])[:, : self.k]
        else:
            order = np.lexsort((i, o, -s), axis=1)[:, : self.k]
        self.score[at], self.id[at], self.null[at] = (np.take_along_axis(x, order, 1) for x in (s, i, o))
        self.kth[at] = np.maximum(self.kth[at], self.score[at, self.k - 1])


def search(found: Found, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> int:
    """Offer blocks (number, low, high, ids, null, vectors) to all queries, by falling bound; pairs of query and block that
    were scored."""
    q = found.q
    bound = np.maximum(q, 0) @ np.array([b[2] for b in blocks]).T + np.minimum(q, 0) @ np.array([b[1] for b in blocks]).T
    bound = _held(bound)
    order = np.argsort(-bound, axis=1, kind="stable")
    scored = 0
    for step in range(len(blocks)):
        at = np.flatnonzero(bound[np.arange(len(q)), order[:, step]] >= found.kth)
        if not len(at):  # bounds fall, and the kth scores rise
            break
        scored += len(at)
        for b in np.unique(order[at, step]):
            number, _, _, ids, null, v = blocks[b]
            found.offer(at[order[at, step] == b], number, ids, null, v)
    return scored


def _answers(length: int, width: str, kind: type, k: int, shared):
    """Kernel: blocks as (uid, query_id, vec_id, score), the best k of the task's blocks for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, names, floors, vectors = shared.value
        found = Found(np.frombuffer(vectors, "<i8").reshape(len(uids), length).astype(kind), floors, uids, k)
        for batch in batches:
            rows = batch.to_pylist()
            for i in range(0, len(rows), BATCH):
                blocks = []
                for b in rows[i : i + BATCH]:
                    null = np.array([x is None for x in b["vec_ids"]])
                    ids = np.array([x or 0 for x in b["vec_ids"]], np.int64)
                    blocks.append((b["block"], np.array(b["low"], kind), np.array(b["high"], kind), ids, null, np.frombuffer(b["vectors"], width).reshape(b["n"], length).astype(kind)))
                if blocks and len(uids):
                    search(found, blocks)
        r, c = np.nonzero(found.score != NEVER)
        score = [int(x) for x in found.score[r, c]]
        ids = pa.array(found.id[r, c], pa.int64(), mask=found.null[r, c])
        yield pa.RecordBatch.from_arrays([pa.array(uids[r], pa.int64()), pa.array(names[r], pa.int64()), ids, pa.array(score, pa.int64())], ["uid", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256, size: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows of vectors(vec_id, embedding) for the rows where `asks`
    holds, `size` queries at a time, from blocks of `block` rows (BLOCK at most)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("ask"), integers(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    length, n, largest = prevailing(rows, "v")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = index(rows.where(F.size("v") == length), length, n, largest, k, block)
    width, kind = _width(largest), _kind(length, largest)
    queries = stage(blocks.mapInArrow(_asks(length, width), "uid long, query_id long, floor double, v binary"), "topk-queries", batch=BATCH)
    slices = max(1, math.ceil(queries.count() / size))
    best = None
    for s in range(slices):
        held = queries.where(F.pmod(F.xxhash64("uid"), F.lit(slices)) == s).collect()
        uids, names = (np.array([r[c] for r in held], np.int64) for c in ("uid", "query_id"))
        shared = spark.sparkContext.broadcast((uids, names, np.array([r["floor"] for r in held], float), b"".join(bytes(r["v"]) for r in held)))
        got = stage(blocks.mapInArrow(_answers(length, width, kind, k, shared), "uid long, query_id long, vec_id long, score long"), "topk-found", batch=BATCH)
        shared.unpersist()
        best = got if best is None else best.unionByName(got)
    w = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """The contract of op13: five rows per query, or all if there are fewer."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)
