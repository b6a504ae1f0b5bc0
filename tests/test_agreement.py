"""The stream that answers a graph once, against the batch consensus, over batches of one file each."""

import datetime as dt
import random

from pyspark.sql import functions as F

from skeinwork.operators import polynomials as poly
from skeinwork.streaming import agreement

START = dt.datetime(2024, 1, 1)


def replay(spark, rows, folder, files, need, idle="1 hour"):
    """Answers of rows(g, ord, poly, ts) in as many batches, and the state rows after each."""
    per = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * per : (i + 1) * per], "g long, ord long, poly string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("g long, ord long, poly string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = agreement.agreements(stream, need, idle).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(agreement.ANSWER).parquet(f"{folder}/out").collect()
    return sorted(tuple(r) for r in got), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_same_answers_as_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(12), i, r.choice(["a", "b", "c", None]), START + dt.timedelta(seconds=i)) for i in range(400)]
    got, _ = replay(spark, rows, str(tmp_path), 4, 3)
    tries = spark.createDataFrame(rows, "g long, ord long, poly string, ts timestamp").drop("ts")
    want = poly.consensus(tries.where("poly IS NOT NULL"), 3).where(F.col("status") == "agreed").select("g", "poly", "found_at").collect()
    assert got == sorted(tuple(x) for x in want) and len(got) == 12


def test_state_of_idle_graphs_goes(spark, tmp_path):
    """Each hour has graphs of its own; those of past hours leave the state, answered or not, and none is answered twice."""
    rows = [(10 * h + g, 100 * h + 10 * k + g, "x" if g < 7 else f"y{k}", START + dt.timedelta(hours=3 * h, seconds=10 * k + g)) for h in range(6) for k in range(4) for g in range(10)]
    got, held = replay(spark, rows, str(tmp_path), 6, 3)
    assert got == sorted((10 * h + g, "x", 100 * h + 20 + g) for h in range(6) for g in range(7))
    assert max(held) <= 20 < 60


def test_rows_without_a_graph_or_time(spark, tmp_path):
    rows = [(None, 1, "x", START), (1, 2, "x", None), (1, 3, "x", START), (1, 4, None, START), (1, 5, "x", START)]
    assert replay(spark, rows, str(tmp_path), 1, 2)[0] == [(1, "x", 5)]
