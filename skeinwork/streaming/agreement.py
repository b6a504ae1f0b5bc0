"""Consensus with an early stop over a stream of tries: a graph is answered once, as soon as one of its polynomials has
come often enough; later tries are dropped, and a graph that gets no more tries is forgotten.

State of a graph: the first places of each polynomial until it is answered, then a mark; both go by a timer. So state grows
with the graphs that still get tries, not with all that ever came, and no batch writes more than its new answers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANSWER = "g bigint, poly string, found_at bigint"


def agreements(tries: DataFrame, need: int, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(g, poly, found_at), once a graph, from a stream of tries(g, ord, poly, ts): the first polynomial to come `need`
    times in the order of ord within what has arrived, and the ord of that last try. Tries with a null poly count for
    nothing. A graph is forgotten `idle` after its last try, by the watermark that is `late` behind; a group of a batch,
    however large, is read in pieces of which `need` places a polynomial are kept."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answered, polys, places, last = state.get if state.exists else (False, [], [], 0)
        first = {p: list(x) for p, x in zip(polys, places)}
        for piece in pieces:
            last = max(last, int(piece["ts"].max().timestamp() * 1000))
            if answered:
                continue
            for poly, at in piece.dropna(subset=["poly"]).groupby("poly")["ord"]:
                first[poly] = heapq.nsmallest(need, [*first.get(poly, []), *map(int, at.nsmallest(need))])
        full = [] if answered else sorted((x[-1], p) for p, x in first.items() if len(x) == need)
        if full:
            answered, first = True, {}
        state.update((answered, list(first), list(first.values()), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        if full:
            yield pd.DataFrame({"g": [key[0]], "poly": [full[0][1]], "found_at": [full[0][0]]})

    kept = "answered boolean, polys array<string>, places array<array<bigint>>, last bigint"
    rows = tries.select("g", "ord", "poly", "ts").where("g IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("g").applyInPandasWithState(step, ANSWER, kept, "append", GroupStateTimeout.EventTimeTimeout)


def collected(stream: DataFrame, folder: str) -> DataFrame:
    """All answers of a stream whose source ends, written once each to a folder that all executors share."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/answers").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(ANSWER).parquet(f"{folder}/answers")
