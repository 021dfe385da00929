"""Streams, an extension: the queue log and the cook log as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_additions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first addition of a recipe by a user within the watermark; later ones are dropped, state is bounded."""
    clicks = events.where("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_id") * 7 % 400).alias("recipe_id"))
    return clicks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "recipe_id"])


def cooks_by_hour(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cooks in each hour; rows later than the watermark are left out."""
    cooks = events.where("event_type = 'purchase'").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", delay)
    return cooks.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("cooks"), F.approx_count_distinct("user_id").alias("users")).select("w.start", "cooks", "users")
