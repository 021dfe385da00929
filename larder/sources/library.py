"""The ingredient library as tables, from entries held in memory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, name string, descr string, pairs string, season array<int>, regions array<string>"


def library(spark: SparkSession, entries: Iterable[dict]) -> dict[str, DataFrame]:
    """Ingredients, the months of each, the regions, and the bridge with each region's place in its entry's list.

    Missing fields are null, entries without months or regions have none. A region's id is its place
    in the order of names.
    """
    fields = [f.split()[0] for f in ENTRY.split(", ")]
    rows = spark.createDataFrame([tuple(e.get(f) for f in fields) for e in entries], ENTRY)
    placed = rows.select(F.col("id").alias("ingredient_id"), F.posexplode("regions").alias("position", "region"))
    names = placed.groupBy().agg(F.array_sort(F.collect_set("region")).alias("names")).select(F.posexplode("names").alias("at", "name"))
    regions = names.select((F.col("at") + 1).cast("long").alias("id"), "name")
    return {
        "ingredients": rows.select("id", "name", "descr", "pairs"),
        "ingredient_seasons": rows.select(F.col("id").alias("ingredient_id"), F.explode("season").alias("month")).distinct(),
        "regions": regions,
        "ingredient_regions": placed.join(regions, F.col("region") == F.col("name")).select("ingredient_id", F.col("id").alias("region_id"), "position"),
    }
