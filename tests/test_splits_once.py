"""Each different quantity is split once, however many lines have it."""

from larder.operators import kitchen


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantities_are_split_once(spark):
    rows = spark.createDataFrame([(1, "2 cups", None, None, 0), (2, None, None, None, 0), (3, "2 cups", "kept", "whole", 0), (4, "2 cups", None, None, 1), (5, "2 cups", None, None, 0)], "id long, qty string, quantity string, unit string, is_heading int")
    told = kitchen.backfill_parts(rows)
    # split below a distinct
    assert "Aggregate [" in plan(told)
    assert told.columns == rows.columns
    assert sorted(tuple(r) for r in told.collect()) == [(1, "2 cups", "2", "cups", 0), (2, None, "", "", 0), (3, "2 cups", "kept", "whole", 0), (4, "2 cups", None, None, 1), (5, "2 cups", "2", "cups", 0)]
    kind = "recipe_id long, ingredients array<struct<heading:string,item:string,qty:string,label:string,note:string,text:string>>"
    seeds = kitchen.seed_rows(spark.createDataFrame([(1, [(None, "fig", "2 cups", "a", None, None), (None, None, None, None, None, "salt"), ("Top", None, "3 g", None, None, None)])], kind))
    assert "Aggregate [" in plan(seeds)
    assert sorted((r.position, r.qty, r.quantity, r.unit) for r in seeds.collect()) == [(0, "2 cups", "2", "cups"), (1, None, "", ""), (2, None, None, None)]
