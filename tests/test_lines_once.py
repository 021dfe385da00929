"""A line's key, repairs and ends are made once, and white space is Unicode's."""

from pyspark.sql import functions as F

from larder.functions import lines, text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_keyed_once(spark):
    rows = spark.createDataFrame([("pie crust",), ("a b c crust",), ("a b crust!",), ("of a long line no key is made: crust",), ("É É É É crust",), ("(, cold) Egg wash::",), ("٣ cups (30 g) rice",), (None,), ("",)], "text string")
    told = rows.select("text", lines.classify_line(F.col("text")).alias("l")).select("text", "l.kind", "l.grams", F.array_join("l.flags", ",").alias("flags"))
    assert plan(told).count("[^a-z0-9 ]+") == 1
    got = {r.text: (r.kind, r.grams, r.flags) for r in told.collect()}
    suggested, ambiguous = ("section", None, "section_suggested"), ("flagged", None, "ambiguous_section")
    assert got["pie crust"] == got["a b crust!"] == got["É É É É crust"] == suggested
    assert got["a b c crust"] == got["of a long line no key is made: crust"] == got[None] == got[""] == ambiguous
    assert got["(, cold) Egg wash::"] == ("section", None, "cleaned_paren_comma")
    assert got["٣ cups (30 g) rice"][:2] == ("ingredient", 30.0)


def test_strip_looks_at_the_ends_only(spark):
    points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    ends = points.select("c", text.strip(F.concat("c", F.lit("a "), "c", F.lit("b"), "c")).alias("t"))
    assert "regexp_replace" not in plan(ends)
    white = F.col("c").rlike(r"(?U)^\s\z")
    want = F.when(white, F.concat(F.lit("a "), "c", F.lit("b"))).otherwise(F.concat("c", F.lit("a "), "c", F.lit("b"), "c"))
    assert ends.where(~F.col("t").eqNullSafe(want)).count() == 0 and ends.where(white).count() == 25
