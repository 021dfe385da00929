"""Batch reports: coverage, histograms, reconciliation, samples and positions of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.plans.registry import query
from larder.plans.views import view, with_views


@query(
    with_views("lines", "ingredients")
    + """SELECT coalesce(i.name, l.raw_text) AS name, count(*) AS n, count(i.name) > 0 AS matched FROM lines l LEFT JOIN ingredients i ON i.id = l.ingredient_id WHERE l.is_heading = 0 GROUP BY 1"""
)
def a5_name_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Names of lines by how often they stand, and whether the library has them."""
    lines = view(spark, d, "lines").where("is_heading = 0").select("ingredient_id", "raw_text")
    names = view(spark, d, "ingredients").select(F.col("id").alias("ingredient_id"), F.col("name").alias("known"))
    out = lines.join(names, "ingredient_id", "left").groupBy(F.coalesce("known", "raw_text").alias("name")).agg(F.count("*").alias("n"), (F.count("known") > 0).alias("matched"))
    return out.orderBy(F.desc("n"), "name")


@query(
    with_views("lines")
    + """SELECT recipe_id, count(*) AS total, count(*) FILTER (ingredient_id IS NULL) AS wont_convert, count(DISTINCT ingredient_id) AS distinct_items FROM lines WHERE is_heading = 0 GROUP BY recipe_id"""
)
def a6_recipe_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each recipe, and those that won't convert."""
    return view(spark, d, "lines").where("is_heading = 0").groupBy("recipe_id").agg(F.count("*").alias("total"), F.count_if(F.col("ingredient_id").isNull()).alias("wont_convert"), F.count_distinct("ingredient_id").alias("distinct_items"))


@query(
    with_views("lines")
    + r"""SELECT CASE WHEN qty = '' THEN 'empty' WHEN regexp_matches(qty, '^[0-9]+$') THEN 'number-only' WHEN regexp_matches(qty, '^[0-9]+ [a-z]+$') THEN 'number+unit' ELSE 'fallback' END AS shape,
  count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS percent FROM lines GROUP BY 1"""
)
def a10_shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A10: shapes of quantities with their share."""
    q = F.col("qty")
    shape = F.when(q == "", "empty").when(q.rlike("^[0-9]+$"), "number-only").when(q.rlike("^[0-9]+ [a-z]+$"), "number+unit").otherwise("fallback")
    counts = view(spark, d, "lines").groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


@query(
    with_views("recipes", "lines", "flags")
    + """SELECT (SELECT count(*) FROM (SELECT name FROM recipes GROUP BY name HAVING count(*) > 1)) AS duplicate_titles, (SELECT count(*) FROM recipes WHERE author = '') AS blank_authors,
  (SELECT count(DISTINCT (recipe_id, position)) FROM flags) AS flagged_lines, (SELECT count(DISTINCT recipe_id) FROM lines WHERE amount > 40) AS heavy_recipes,
  (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM lines) = (SELECT count(DISTINCT (recipe_id, position, tiebreak)) FROM lines) AS as_expected"""
)
def a9_import_summary(spark: SparkSession, d: str) -> DataFrame:
    """The dry run's figures in one row, each from one aggregate."""
    recipes, lines, flags = (view(spark, d, n) for n in ("recipes", "lines", "flags"))
    titles = recipes.groupBy("name").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_titles"))
    authors = recipes.agg(F.count_if(F.col("author") == "").alias("blank_authors"))
    flagged = flags.agg(F.count_distinct(F.struct("recipe_id", "position")).alias("flagged_lines"))
    heavy = lines.agg(F.count_distinct(F.when(F.col("amount") > 40, F.col("recipe_id"))).alias("heavy_recipes"), F.count("*").alias("lines"), (F.count("*") == F.count_distinct(F.struct("recipe_id", "position", "tiebreak"))).alias("as_expected"))
    return titles.crossJoin(authors).crossJoin(flagged).crossJoin(heavy)


@query(with_views("flags") + "SELECT flag, reason, count(*) AS n FROM flags GROUP BY GROUPING SETS ((flag, reason), (flag), ())")
def a11_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Flags by kind and reason, with totals."""
    return view(spark, d, "flags").rollup("flag", "reason").agg(F.count("*").alias("n"))


@query(
    with_views("recipes")
    + "SELECT lower(trim(author)) AS author, count(*) AS n, arg_min(id, (md5(id::VARCHAR || ':5'), id)) AS sampled FROM recipes WHERE author <> '' GROUP BY 1"
)
def a17_author_sample(spark: SparkSession, d: str) -> DataFrame:
    """One seeded random recipe of each author, as a minimum of a hash."""
    draw = F.struct(F.md5(F.concat(F.col("id").cast("string"), F.lit(":5"))).alias("h"), "id")
    return view(spark, d, "recipes").where("author <> ''").groupBy(F.lower(F.trim("author")).alias("author")).agg(F.count("*").alias("n"), F.min(draw)["id"].alias("sampled"))


@query(
    with_views("ingredients")
    + """SELECT name, count(*) AS n, min(id) AS first_id, max(id % 5) - min(id % 5) <= 1 AS agrees FROM ingredients GROUP BY name"""
)
def a13_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether all entries of a name agree, and its first entry."""
    value = F.col("id") % 5
    return view(spark, d, "ingredients").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), (F.max(value) - F.min(value) <= 1).alias("agrees"))


STEPS_SQL = "steps AS (SELECT doc_id AS recipe_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)"


def is_heading(line: Column) -> Column:
    """1 for a line that ends with a colon or has no small letters, else 0."""
    return F.coalesce(line.endswith(":") | (line.rlike("[A-Z]") & ~line.rlike("[^ -Z\\[-`{-~]")), F.lit(False)).cast("int")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a recipe: a document's lines with their places; a heading ends with a colon or has no small letters."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("recipe_id"), "text")
    split = docs.select("recipe_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    return split.withColumn("is_heading", is_heading(F.col("text")))


@query(
    f"""WITH {STEPS_SQL}, marked AS (SELECT recipe_id, position, text, (text LIKE '%:' OR (regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[^ -Z\\[-`{{-~]')))::INT AS is_heading FROM steps)
SELECT recipe_id, position::BIGINT AS position, is_heading,
  CASE WHEN is_heading = 0 THEN sum(1 - is_heading) OVER w - 1 END::BIGINT AS ordinal,
  last_value(CASE WHEN is_heading = 1 THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY recipe_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section,
  coalesce(sum(1 - is_heading) OVER (PARTITION BY recipe_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM marked WINDOW w AS (PARTITION BY recipe_id ORDER BY position)"""
)
def w3_sections(spark: SparkSession, d: str) -> DataFrame:
    """Places of steps, their ordinals without headings, and the heading strictly before each."""
    order = Window.partitionBy("recipe_id").orderBy("position")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    content = 1 - F.col("is_heading")
    return steps(spark, d).select(
        "recipe_id", F.col("position").cast("bigint").alias("position"), "is_heading",
        F.when(F.col("is_heading") == 0, F.sum(content).over(so_far) - 1).alias("ordinal"),
        F.last(F.when(F.col("is_heading") == 1, F.md5("text")), ignorenulls=True).over(before).alias("section"),
        F.coalesce(F.sum(content).over(before), F.lit(0)).alias("before"),
    )


@query(
    with_views("lines")
    + """, a AS (SELECT recipe_id, raw_text AS k, row_number() OVER (PARTITION BY recipe_id, raw_text ORDER BY position, tiebreak) AS rn FROM lines WHERE position < 4),
b AS (SELECT recipe_id, raw_text AS k, row_number() OVER (PARTITION BY recipe_id, raw_text ORDER BY position, tiebreak) AS rn FROM lines WHERE position >= 3)
SELECT coalesce(a.recipe_id, b.recipe_id) AS recipe_id, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS moved, count(*) FILTER (b.k IS NULL) AS removed, count(*) FILTER (a.k IS NULL) AS added
FROM a FULL JOIN b ON a.recipe_id = b.recipe_id AND a.k = b.k AND a.rn = b.rn GROUP BY 1"""
)
def w9_move_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Removed and added rows with one key pair off one to one; what is left is a real change."""
    lines = view(spark, d, "lines").select("recipe_id", F.col("raw_text").alias("k"), "position", "tiebreak")
    rn = F.row_number().over(Window.partitionBy("recipe_id", "k").orderBy("position", "tiebreak"))
    old = lines.where("position < 4").withColumn("rn", rn).select("recipe_id", "k", "rn", F.lit(1).alias("o"))
    new = lines.where("position >= 3").withColumn("rn", rn).select("recipe_id", "k", "rn", F.lit(1).alias("n"))
    both = old.join(new, ["recipe_id", "k", "rn"], "full")
    return both.groupBy("recipe_id").agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("moved"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNull()).alias("added"))


@query(
    with_views("recipes", "cook_log")
    + """SELECT substring(c.cooked_on, 1, 10) AS day, r.category, count(*) AS cooks, count(DISTINCT c.user_id) AS cooks_by FROM cook_log c JOIN recipes r ON r.id = c.recipe_id GROUP BY 1, 2"""
)
def x_cooks_by_day(spark: SparkSession, d: str) -> DataFrame:
    """An extension beyond the read model: cooks by day and category."""
    recipes = view(spark, d, "recipes").select(F.col("id").alias("recipe_id"), "category")
    return view(spark, d, "cook_log").join(recipes, "recipe_id").groupBy(F.col("cooked_on").alias("day"), "category").agg(F.count("*").alias("cooks"), F.count_distinct("user_id").alias("cooks_by"))
