"""Consensus over a stream of polynomial tries: counts per graph and polynomial, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tallies(stream: DataFrame) -> DataFrame:
    """(g, poly, n) of a stream or table of tries(g, poly); state grows with distinct pairs only."""
    return stream.where("poly IS NOT NULL").groupBy("g", "poly").agg(F.count("*").alias("n"))


def agreed(counts: DataFrame, overlaps: int) -> DataFrame:
    """(g, polys): how many polynomials of a graph have come `overlaps` times."""
    return counts.where(F.col("n") >= overlaps).groupBy("g").agg(F.count("*").alias("polys"))


def settle(counts: DataFrame, folder: str) -> DataFrame:
    """Run a stream of counts until its source is empty and return the final table. Each batch replaces the table in
    `folder`, which all executors must share."""

    def save(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/table")

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.read.parquet(f"{folder}/table")


def drain(tries: DataFrame, folder: str) -> DataFrame:
    """The final tallies of a stream of tries."""
    return settle(tallies(tries), folder)


def event_tries(spark: SparkSession, sf_dir: str, streaming: bool = True) -> DataFrame:
    """Tries from the event stream: a graph per user group, the event type and a remainder as the polynomial's text."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if streaming else spark.read.parquet(path)
    return rows.select((F.col("user_id") % 50).cast("bigint").alias("g"), F.concat_ws(":", "event_type", (F.col("event_id") % 3)).alias("poly"))


def windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n): tumbling counts behind a watermark, for streams that never end."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
