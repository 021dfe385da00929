"""Each snapshot is parsed once, however many differences name it."""

from pyspark.sql import functions as F

from larder.operators import tracking


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snapshots_are_parsed_once(spark):
    none = F.array().cast(f"array<{tracking._LINE}>")
    step = lambda t: F.array(F.struct(F.lit(0).alias("position"), F.lit(0).alias("is_heading"), F.lit(t).alias("text")))
    recipe = lambda name: F.struct(*(F.when(F.lit(f) == "name", name).alias(f) for f in tracking.FIELDS))
    df = spark.range(2).select(F.col("id").alias("recipe_id"), tracking.snapshot(recipe("a"), none, step("Stir well")).alias("old"), tracking.snapshot(recipe(F.when(F.col("id") == 1, "b").otherwise("a")), none, step("Stir it well")).alias("new"))
    got = tracking.changes(df)
    assert plan(got).count("from_json(") == 2
    told = sorted((r.recipe_id, r.kind, r.type, r.field or "", r["from"], r.to) for r in got.collect())
    assert told == [(0, "step", "modified", "", "Stir well", "Stir it well"), (1, "field", "modified", "name", "a", "b"), (1, "step", "modified", "", "Stir well", "Stir it well")]
