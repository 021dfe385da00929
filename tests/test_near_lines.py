"""Lines of one order are aligned without a search, and texts are compared once."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from larder.operators import tracking

FULL = [f"Step {i:02d} of this recipe." for i in range(8)]


def reworded(sign, k):
    return [x for i, t in enumerate(FULL) for x in (t, "a" * k + sign * (18 - k) + f"{i:02d}")]


def test_lines_in_order_are_not_searched(monkeypatch):
    made = []

    def matcher(*args, **kwargs):
        made.append(args)
        return SequenceMatcher(*args, **kwargs)

    monkeypatch.setattr(tracking, "SequenceMatcher", matcher)
    known = {}
    for _ in range(20):
        for k in (2, 9, 10, 17):
            got = list(tracking._align(reworded("b", k), reworded("c", k), known))
            each = [(2 * i + 1, 2 * i + 1) for i in range(8)]
            assert got == (each if k >= 10 else [x for i, j in each for x in ((i, None), (None, j))])
    assert len(made) <= 2 * 8


def test_repeated_and_turned_lines_are_searched():
    assert tracking._in_order(["a", "x", "b"], ["y", "a", "b"]) == [(0, 1), (2, 2)]
    assert tracking._in_order(["x", "x", "a"], ["y", "y", "a"]) == [(2, 2)]
    for a, b in ((["a", "b"], ["b", "a"]), (["a", "a"], ["a"]), (["a"], ["a", "a"])):
        assert tracking._in_order(a, b) is None
    assert list(tracking._align(["a", "a"], ["a"])) == [(1, None)]


def test_slices_and_forgotten_likenesses(spark, monkeypatch):
    """Rows of several slices, with headings, null texts and empty sides, are told as each is alone."""
    monkeypatch.setattr(tracking, "ROWS", 7)
    monkeypatch.setattr(tracking, "REMEMBERED", 3)
    schema = "recipe_id int, old array<struct<position:int,is_heading:int,text:string>>, new array<struct<position:int,is_heading:int,text:string>>"
    rows = [(n, [] if n % 5 == 0 else [(0, 1, f"TOP {n}"), (1, 0, None), (2, None, f" gone {n} ")], [(0, 0, f"wholly new {n}"), (1, 0, "")]) for n in range(40)]
    recipe = F.struct(*(F.lit(None).cast("string").alias(f) for f in tracking.FIELDS))
    none = F.array().cast(f"array<{tracking._LINE}>")
    df = spark.createDataFrame(rows, schema).coalesce(1)
    pairs = df.select("recipe_id", *(tracking.snapshot(recipe, none, F.col(side)).alias(side) for side in ("old", "new")))
    got = sorted((r.recipe_id, r.type, r.kind, r.text, r.section) for r in tracking.changes(pairs).collect())
    want = []
    for n in range(40):
        want.append((n, "added", "step", f"wholly new {n}", None))
        if n % 5 == 0:
            want.append((n, "added", "step", "", None))
        else:
            want += [(n, "removed", "heading", f"TOP {n}", None), (n, "removed", "step", f"gone {n}", f"TOP {n}")]
    assert got == sorted(want)


def test_contents_need_no_text(spark):
    """Snapshots as contents give what their texts give; equal and null ones give nothing."""
    schema = "recipe_id int, old array<struct<position:int,is_heading:int,text:string>>, new array<struct<position:int,is_heading:int,text:string>>"
    rows = [(1, [(0, 0, "Bake."), (1, 0, None)], [(0, 0, "Bake it.")]), (2, [(0, 0, "same")], [(0, 0, "same")]), (3, [(0, 1, "TOP")], None)]
    recipe = F.struct(*(F.lit("x" if f == "name" else None).cast("string").alias(f) for f in tracking.FIELDS))
    none = F.array().cast(f"array<{tracking._LINE}>")
    df = spark.createDataFrame(rows, schema)
    told = []
    for made in (tracking.content, tracking.snapshot):
        sides = (F.when(F.col(side).isNotNull(), made(recipe, none, F.col(side))).alias(side) for side in ("old", "new"))
        told.append(sorted(map(repr, tracking.changes(df.select("recipe_id", *sides)).collect())))
    assert told[0] == told[1] and len(told[0]) == 2 and all("recipe_id=1" in r for r in told[0])
