"""Slugs for a batch, unique among themselves and among those taken.

In the order of the batch each row takes its base, or the base with the smallest free number from 2
on. That is a running number within the base, unless a slug of that form is claimed otherwise: such
bases are settled one family, bases that differ by trailing numbers, at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions.shipping import ship
from larder.operators.lineage import checkpoint

ship(__name__)


def _number(frame: pd.DataFrame) -> pd.DataFrame:
    taken = set(frame.loc[frame["entry"].isna(), "base"])
    rows = frame[frame["entry"].notna()].sort_values("entry")
    following: dict[str, int] = {}
    out = []
    for base in rows["base"]:
        slug, n = base, following.get(base, 2)
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        following[base] = n
        taken.add(slug)
        out.append(slug)
    return pd.DataFrame({"entry": rows["entry"].astype("int64"), "slug": out})


def numbered(rows: DataFrame, keys: list[str], order: str, width: int = 10_000) -> DataFrame:
    """``rows`` with ``nth``, from 1 on, by ``order`` (a long) within ``keys``.

    Ranges of ``width`` values are numbered each for itself and start from the counts of those before
    them, so that a key with very many rows isn't gathered; only its ranges' counts are.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)))
    return placed.join(counts, [*keys, "_range"]).withColumn("nth", F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")


def placed(rows: DataFrame, keys: list[str], names: list[str], last: str) -> DataFrame:
    """``rows`` with ``place``, from 1 on, within ``keys`` by ``names`` and then by ``last`` (a long); none of them null.

    Rows of equal names are numbered by ranges and start from the counts of those before, so one task sees
    a key's different names with their counts and not its rows.
    """
    counts = rows.groupBy(*keys, *names).agg(F.count("*").alias("_c"))
    ahead = F.sum("_c").over(Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, *names, F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = numbered(rows, [*keys, *names], last)
    return inside.join(counts, [*keys, *names]).withColumn("place", F.col("_ahead") + F.col("nth")).drop("_ahead", "nth")


def mint(batch: DataFrame, taken: DataFrame) -> DataFrame:
    """(entry, slug) for rows (entry long, base string), given the taken slugs (slug string).

    A base that is taken, or may meet a slug of another row or a taken one by its number, is settled
    within its family in entry order; all others are numbered by windows.
    """
    # named seven times below
    rows = checkpoint(batch.select(F.col("entry").cast("long").alias("entry"), "base"))
    stem = lambda c: F.regexp_replace(c, r"-[0-9]+$", "")
    bases = rows.select("base").distinct()
    claims = bases.select(F.col("base").alias("slug")).unionByName(taken.select("slug").distinct())
    # a numbered claim and the base that its number is cut from can meet, as can a taken base
    met = claims.where(stem(F.col("slug")) != F.col("slug")).select("slug", stem(F.col("slug")).alias("base")).join(bases, "base", "left_semi")
    contested = met.select("base").unionByName(met.select(F.col("slug").alias("base"))).unionByName(taken.select(F.col("slug").alias("base"))).distinct()
    family = F.regexp_replace("base", r"(-[0-9]+)+$", "").alias("family")
    free = numbered(rows.join(contested, "base", "left_anti"), ["base"], "entry")
    free = free.select("entry", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("nth").cast("string"))).alias("slug"))
    held = rows.join(contested, "base", "left_semi").unionByName(taken.select(F.lit(None).cast("long").alias("entry"), F.col("slug").alias("base"))).select(family, "entry", "base")
    return free.unionByName(held.groupBy("family").applyInPandas(_number, "entry long, slug string"))
