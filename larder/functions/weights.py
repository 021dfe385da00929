"""Ingredient names and their densities: decline rather than guess.

A line's name is looked up exactly, then by its base name where all entries of that base agree, then
through an alias in the same two ways. The chart is small and the joins are equi-joins on its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.amounts import reference_ml
from larder.functions.text import strip

# Names that mean a chart entry.
ALIASES = {
    "olive oil": ("extra virgin olive oil", "virgin olive oil", "evoo"),
    "confectioners' sugar": ("powdered sugar", "icing sugar"),
    "baking soda": ("bicarbonate of soda", "bicarb"),
    "all-purpose flour": ("plain flour", "king arthur unbleached all purpose flour"),
    "salt (kosher diamond crystal)": ("kosher salt", "diamond crystal kosher salt"),
    "sugar (granulated white)": ("granulated sugar", "white granulated sugar"),
    "brown sugar (packed)": ("light brown sugar", "dark brown sugar", "packed dark brown sugar"),
    "milk (fresh)": ("whole milk",),
    "cream (heavy/light/half & half)": ("heavy cream", "double cream", "half and half"),
    "butter": ("unsalted butter", "salted butter"),
    "yogurt": ("plain yogurt",),
    "chocolate chips": ("semisweet chocolate chips", "dark chocolate chips"),
    "cocoa (unsweetened)": ("unsweetened cocoa", "cocoa powder"),
    "water": ("ice water", "ice cold water", "warm water"),
    "lemon juice": ("fresh lemon juice",),
    "vanilla extract": ("vanilla", "king arthur pure vanilla extract"),
    "oats (rolled)": ("rolled oats",),
    "tahini paste": ("tahini",),
    "breadcrumbs (japanese panko)": ("panko crumbs",),
    "salt (table)": ("table salt",),
}


def name_key(name: Column) -> Column:
    """Small letters and digits up to the first comma."""
    s = F.split(strip(F.lower(F.coalesce(name, F.lit("")))), ",")[0]
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " "))


def base_key(name: Column) -> Column:
    return name_key(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "))


def density_chart(rows: DataFrame) -> DataFrame:
    """(ordinal, lookup_key, display_name, grams_per_ml, convert) of chart rows (ordinal, ingredient, grams, reference_volume); unreadable ones go."""
    ml = reference_ml(F.col("reference_volume"))
    rows = rows.where(F.coalesce(strip(F.col("ingredient")), F.lit("")) != "").withColumn("ml", ml).where("grams IS NOT NULL AND ml > 0")
    return rows.select("ordinal", name_key(F.col("ingredient")).alias("lookup_key"), strip(F.col("ingredient")).alias("display_name"), (F.col("grams") / F.col("ml")).alias("grams_per_ml"), F.lit(True).alias("convert"))


def chart_index(chart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, hit) by exact key, first entry first, and by base name where the densities agree."""
    hit = F.struct("grams_per_ml", "display_name", F.coalesce("convert", F.lit(True)).alias("convert"))
    exact = chart.groupBy(F.col("lookup_key").alias("key")).agg(F.min_by(hit, "ordinal").alias("hit"))
    base = chart.groupBy(base_key(F.col("display_name")).alias("key")).agg(F.min_by(hit, "ordinal").alias("hit"), (F.max("grams_per_ml") - F.min("grams_per_ml") <= 1e-9).alias("agree"))
    return exact, base.where("agree").drop("agree")


def match_weights(lines: DataFrame, name: str, chart: DataFrame) -> DataFrame:
    """``lines`` with ``weight``: (grams_per_ml, display_name, convert) of the entry that the name means, or null."""
    exact, base = chart_index(chart)
    alias = F.create_map(*(F.lit(x) for target, names in ALIASES.items() for n in names for x in (n, target)))
    keyed = lines.withColumns({"_n": name_key(F.col(name)), "_b": base_key(F.col(name))})
    keyed = keyed.withColumn("_a", name_key(F.coalesce(alias[F.col("_n")], alias[F.col("_b")])))
    hits = []
    for i, (key, side) in enumerate((("_n", exact), ("_b", base), ("_a", exact), ("_a", base))):
        keyed = keyed.join(side.select(F.col("key").alias(f"_k{i}"), F.col("hit").alias(f"_h{i}")).where(f"_k{i} <> ''"), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        hits.append(F.col(f"_h{i}"))
    return keyed.withColumn("weight", F.coalesce(*hits)).drop("_n", "_b", "_a", *(f"_h{i}" for i in range(4)))
