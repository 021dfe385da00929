"""Imports: from pages to a write plan, its preview and the rows to stage, as DataFrames throughout.

A page's record is read once, and what is read of a batch is kept by checkpoints, since the tables that
come from it name it many times. Its lines and steps become rows of their own; each different line is
classified once, by expressions, and a recipe is put together by aggregates on its id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import lines, pages, text
from larder.functions.amounts import quantity_text
from larder.operators.lineage import checkpoint
from larder.operators.slugs import mint

# Reasons of review flags, and the flag and layer that say how a page was read.
REASONS = {
    "cleaned_paren_comma": "removed a stray comma after '(' — publisher artifact",
    "cleaned_double_paren": "collapsed a doubled parenthesis — publisher artifact",
    "grams_declined": "a gram value was present but not confidently harvested",
    "multiplier": "N x SIZE multiplier — ambiguous semantics, review",
    "each_multi": "'each' distributes one amount over several ingredients — review",
    "section_suggested": "no amount, matches section pattern — treated as section header, confirm",
}
UNCLEAR = "no amount and not clearly a section — suggest "
READ_BY, LAYER = "imported_via", "json-ld"
PREVIEW_LINE = ("position", "is_heading", "qty", "quantity", "unit", "label", "raw_text", "grams", "secondary_measure")


def json_ld(page: Column) -> Column:
    """The reader of JSON-LD blocks; pages without one never leave the JVM."""
    return pages.page_record(F.when(page.rlike(r"(?i)application/ld\+json"), page))


#: Readers in the order of their authority: a page's text to a record, or to a refusal with its context.
LAYERS: tuple[tuple[str, Callable[[Column], Column]], ...] = ((LAYER, json_ld),)


def read(source: DataFrame, layers: Sequence[tuple[str, Callable[[Column], Column]]] = LAYERS) -> DataFrame:
    """(id, url, refusal, context, name, ..., layer, refusals) of pages (id, url, text), in one scan.

    Each reader sees the pages that all before it refused, and a null for the others; the first that reads
    one is its ``layer``. ``refusals`` holds (layer, code, context) of those before it. A page that every
    reader refused has the first one's code as its ``refusal``. A null text is a page without content.
    """
    fields = [f.name for f in pages.SCHEMA.fields]
    none = F.array().cast("array<struct<layer:string,code:string,context:array<string>>>")
    rows = source.select("id", "url", "text", F.lit(None).cast(pages.SCHEMA).alias("_r"), F.lit(None).cast("string").alias("layer"), none.alias("refusals"))
    for name, reader in layers:
        rows = rows.withColumn("_x", reader(F.when(F.col("layer").isNull(), F.coalesce("text", F.lit("")))))
        refused = F.struct(F.lit(name).alias("layer"), F.col("_x.refusal").alias("code"), F.col("_x.context").alias("context"))
        open_ = F.col("layer").isNull()
        good = open_ & F.col("_x.refusal").isNull()
        rows = rows.select("id", "url", "text", F.when(good, F.col("_x")).otherwise(F.col("_r")).alias("_r"), F.when(good, F.lit(name)).otherwise(F.col("layer")).alias("layer"), F.when(open_ & ~good, F.concat("refusals", F.array(refused))).otherwise(F.col("refusals")).alias("refusals"))
    first = lambda c: F.when(F.col("layer").isNull(), F.get("refusals", F.lit(0))[c])
    told = {"refusal": first("code"), "context": first("context")}
    return rows.select("id", "url", *(told.get(c, F.col(f"_r.{c}")).alias(c) for c in fields), "layer", "refusals")


def classified(records: DataFrame) -> DataFrame:
    """(id, position, l): each ingredient line of the records, read with its recipe's section names as hints.

    Lines that are the same under the same hints are read once, however many recipes have them.
    """
    good = records.where("refusal IS NULL").select("id", lines.step_hints(F.col("directions")).alias("hints"), "ingredient_lines")
    rows = good.select("id", "hints", F.posexplode("ingredient_lines").alias("position", "line"))
    known = rows.select("line", "hints").distinct().select("line", "hints", lines.classify_line(F.col("line"), F.col("hints")).alias("l"))
    return rows.join(known, ["line", "hints"]).select("id", "position", "l")


def line_rows(read_lines: DataFrame) -> DataFrame:
    """Rows of ingredient lines. A section is a heading with its text and nothing else."""
    heading = F.col("l.kind") == "section"
    unless = lambda c: F.when(~heading, c)
    qty = unless(quantity_text(F.nullif(F.col("l.amount"), F.lit("")), F.nullif(F.col("l.unit"), F.lit(""))))
    return read_lines.select(
        "id", "position", heading.cast("int").alias("is_heading"), qty.alias("qty"),
        F.when(qty.isNotNull(), F.col("l.amount")).alias("quantity"), F.when(qty.isNotNull(), F.col("l.unit")).alias("unit"),
        unless(F.nullif(F.col("l.name"), F.lit(""))).alias("label"), F.when(heading, F.col("l.name")).otherwise(text.strip(F.col("l.raw"))).alias("raw_text"),
        unless(F.col("l.grams")).alias("grams"), unless(F.col("l.secondary")).alias("secondary_measure"),
    )


def step_rows(records: DataFrame) -> DataFrame:
    """Rows of steps; a heading's trailing dash goes."""
    rows = records.where("refusal IS NULL").select("id", F.posexplode("directions").alias("position", "line"))
    read_step = lines.classify_step(F.col("line"))
    return rows.select("id", "position", read_step["is_heading"].cast("int").alias("is_heading"), read_step["text"].alias("text"))


def _reason(flag: Column, suggestion: Column) -> Column:
    known = F.create_map(*(F.lit(x) for p in REASONS.items() for x in p))
    return F.coalesce(known[flag], F.when(flag == "ambiguous_section", F.concat(F.lit(UNCLEAR), suggestion)))


def flag_rows(read_lines: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each flag of a line, and one for each record that says how it was read."""
    own = read_lines.select("id", "position", F.explode("l.flags").alias("flag"), F.col("l.suggestion").alias("s")).select("id", "position", "flag", _reason(F.col("flag"), F.col("s")).alias("reason"))
    how = records.where("refusal IS NULL").select("id", F.lit(None).cast("int").alias("position"), F.lit(READ_BY).alias("flag"), F.col("layer").alias("reason"))
    return own.unionByName(how)


def recipe_rows(records: DataFrame, taken: DataFrame) -> DataFrame:
    """the recipe of each record, with a slug that is free in the batch and among those taken."""
    good = records.where("refusal IS NULL")
    slugs = mint(good.select(F.col("id").alias("entry"), text.slug_base(F.col("name")).alias("base")), taken)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return good.join(slugs, F.col("id") == F.col("entry")).select(
        "id", "slug", "name", F.nullif(F.col("source"), F.lit("")).alias("author"), F.col("url").alias("source_url"), text.joined_tags(F.col("categories")).alias("category"),
        lines.parse_servings(F.col("servings_raw")).cast("string").alias("servings"), blank("prep_time"), blank("cook_time"), blank("total_time"), F.nullif(F.col("description"), F.lit("")).alias("descr"),
    )


def preview(source: DataFrame, taken: DataFrame, known: DataFrame) -> DataFrame:
    """For each page its plan in one nested row, or its refusal.

    ``known`` (id, source_key) are the recipes already there: the first with the page's address is a
    warning. What the server would mint or never fill is left out.
    """
    from larder.functions.urls import source_key

    records = checkpoint(read(source))
    found = checkpoint(classified(records))
    nest = lambda rows, *columns: rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    ingredients = nest(line_rows(found), *PREVIEW_LINE).withColumnRenamed("r", "ingredients")
    steps = nest(step_rows(records), "position", "is_heading", "text").withColumnRenamed("r", "steps")
    flags = nest(flag_rows(found, records), "position", "flag", "reason").withColumnRenamed("r", "review_flags")
    first = known.where("source_key <> ''").groupBy("source_key").agg(F.min("id").alias("duplicate_of"))
    planned = recipe_rows(records, taken).withColumn("source_key", source_key(F.col("source_url"))).join(first, "source_key", "left").drop("source_key")
    for part in (ingredients, steps, flags):
        planned = planned.join(part, "id", "left")
    return records.select("id", "refusal", "context").join(planned, "id", "left")


def staged(source: DataFrame, taken: DataFrame, owner: int) -> dict[str, DataFrame]:
    """Q17: the rows that a commit of the batch writes, by table. No baseline is among them: the first save takes it."""
    records = checkpoint(read(source))
    found = checkpoint(classified(records))
    recipes = checkpoint(recipe_rows(records, taken))
    slugs = recipes.select("id", F.col("slug").alias("recipe_id"))
    under = lambda rows: rows.join(slugs, "id").drop("id")
    return {
        "recipes": recipes.drop("id").withColumnRenamed("slug", "id").withColumns({"source": F.lit("app"), "owner": F.lit(owner).cast("long")}),
        "recipe_ingredients": under(line_rows(found)),
        "recipe_steps": under(step_rows(records)),
        "import_flags": under(flag_rows(found, records)),
    }
