"""Queries of streams with state of their own, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import agreement
from .common import shared_dir

NEED = 5


def tries(spark, d):
    """Events as a stream of tries: a graph a user, the type of event as the polynomial, in the order of time."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("user_id").cast("bigint").alias("g"), F.col("event_id").cast("bigint").alias("ord"), F.col("event_type").alias("poly"), F.col("ts").cast("timestamp").alias("ts"))


def _agreed(spark, d):
    return agreement.collected(agreement.agreements(tries(spark, d), NEED), f"{shared_dir(spark).rstrip('/')}/agreed-{uuid.uuid4().hex}")


AGREED = f"WITH r AS (SELECT CAST(user_id AS BIGINT) g, CAST(event_id AS BIGINT) ord, event_type poly, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL) SELECT g, arg_min(poly, ord) AS poly, min(ord) AS found_at FROM r WHERE n = {NEED} GROUP BY g"


def plans():
    return {"consensus_stream": (_agreed, AGREED)}
