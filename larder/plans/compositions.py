"""Compositions: the whole recipe page, import preview and commit, batches of photos, cooks and created recipes, snapshots and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import steps, text, urls, weights
from larder.functions.lines import classify_step
from larder.functions.pages import SCHEMA
from larder.operators import imports, kitchen, slugs, tracking
from larder.operators.lineage import checkpoint
from larder.plans.reads import queue, ratings
from larder.plans.registry import query
from larder.plans.shapes import METHOD, PAGE_FIELDS, PAGES, QUANTITIES, answers, chosen
from larder.plans.understanding import chart
from larder.plans.views import ME, view, with_views

TODAY = "2024-01-20"
_RATINGS = "ratings AS (SELECT recipe_id, user_id, rating FROM rating_log WHERE rating BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY recipe_id, user_id ORDER BY rated_on DESC, id DESC) = 1)"


def _line_details(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their names and, where the chart says to convert, densities."""
    names = view(spark, d, "ingredients").select(F.col("id").alias("ingredient_id"), "name")
    rows = view(spark, d, "lines").join(names, "ingredient_id", "left").select("recipe_id", "position", "tiebreak", "is_heading", F.coalesce("name", "raw_text").alias("shown"))
    density = weights.match_weights(rows.where("is_heading = 0").select("shown").distinct(), "shown", chart(spark, d)).select("shown", F.when(F.col("weight.convert"), F.col("weight.grams_per_ml")).alias("density"))
    rows = rows.join(density, "shown", "left")
    return rows.select("recipe_id", "position", "tiebreak", "is_heading", "shown", F.when(F.col("is_heading") == 0, F.col("density")).alias("grams_per_ml"))


def recipe_details(spark: SparkSession, d: str) -> DataFrame:
    """The nested rows of :func:`larder.operators.kitchen.recipe_detail` for one user."""
    cooks = view(spark, d, "cook_log")
    last = F.max(F.struct("cooked_on", "id", "source"))
    stats = cooks.groupBy("recipe_id", "user_id").agg(F.count("*").alias("cook_count"), F.max("cooked_on").alias("last_cooked"), (last["source"] == "import").alias("provisional"))
    photos = view(spark, d, "photos").select("id", "recipe_id", "path", "position", "cook_log_id").join(cooks.select(F.col("id").alias("cook_log_id"), "cooked_on"), "cook_log_id", "left")
    read = classify_step(F.col("text"))["is_heading"]
    method = view(spark, d, "method").select("recipe_id", "position", read.cast("int").alias("is_heading"), "text", F.when(~read, steps.client_spans(F.col("text"))).alias("spans"))
    entries = tracking.changes(_edited(spark, d)).select("recipe_id", "kind", "type", "field", "from", "to", "text", "new_pos", "old_pos")
    recipes = view(spark, d, "recipes").select("id", "name", "source", "owner", "image", "servings")
    return kitchen.recipe_detail(recipes, _line_details(spark, d), method, stats, ratings(spark, d), queue(spark, d), photos, entries, ME)


@query(
    with_views("recipes", "lines", "ingredients", "cook_log", "rating_log", "queue_log", "photos", "method")
    + f""", {_RATINGS}, chart AS (SELECT name, min(id) AS ordinal FROM ingredients GROUP BY name),
shown AS (SELECT recipe_id, l.position, tiebreak, is_heading, coalesce(i.name, raw_text) AS shown FROM lines l LEFT JOIN ingredients i ON i.id = l.ingredient_id),
ing AS (SELECT recipe_id, count(*) AS n, count(*) FILTER (is_heading = 0 AND ordinal % 2 = 0) AS dense, round(sum(CASE WHEN is_heading = 0 AND ordinal % 2 = 0 THEN length(name) / 10.0 END)::DOUBLE, 6) AS total,
  string_agg(shown, '|' ORDER BY position, tiebreak, is_heading, shown) AS names FROM shown LEFT JOIN chart ON chart.name = shown.shown GROUP BY recipe_id),
met AS (SELECT recipe_id, string_agg(spans, '/' ORDER BY position, text) AS spans FROM (SELECT recipe_id, position, text, {chosen("shape", METHOD, "spans", "NULL")} AS spans FROM method) GROUP BY recipe_id),
alb AS (SELECT p.recipe_id, string_agg(p.id::VARCHAR || coalesce('@' || c.cooked_on, '') || CASE WHEN p.path = r.image THEN '*' ELSE '' END, '|' ORDER BY p.position IS NULL, p.position, p.id) AS album
  FROM photos p JOIN recipes r ON r.id = p.recipe_id LEFT JOIN cook_log c ON c.id = p.cook_log_id GROUP BY p.recipe_id),
edits AS (SELECT recipe_id, 1 AS n FROM method WHERE shape NOT IN (5, 7) AND recipe_id % 3 <> 0 GROUP BY recipe_id)
SELECT r.id, r.name, r.source IN ('app', 'test') AS is_editable, coalesce(r.owner = {ME}, false) AS is_mine, EXISTS (SELECT 1 FROM queue_log q WHERE q.recipe_id = r.id AND q.user_id = {ME}) AS is_queued,
  (SELECT count(*) FROM cook_log c WHERE c.recipe_id = r.id AND c.user_id = {ME}) AS cook_count, (SELECT arg_max(source, (cooked_on, id)) FROM cook_log c WHERE c.recipe_id = r.id AND c.user_id = {ME}) = 'import' AS provisional,
  (SELECT rating FROM ratings t WHERE t.recipe_id = r.id AND t.user_id = {ME}) AS rating, coalesce(ing.n, 0) AS n_lines, coalesce(dense, 0) AS n_dense, coalesce(total, 0) AS density, coalesce(names, '') AS names,
  coalesce(spans, '') AS spans, coalesce(album, '') AS album, coalesce(edits.n, 0)::BIGINT AS n_annotations
FROM recipes r LEFT JOIN ing ON ing.recipe_id = r.id LEFT JOIN met ON met.recipe_id = r.id LEFT JOIN alb ON alb.recipe_id = r.id LEFT JOIN edits ON edits.recipe_id = r.id"""
)
def q2_recipe_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every recipe's page for one user, its nested parts told as text."""
    said = lambda c, f, sep: F.array_join(F.transform(c, f), sep)
    dense = F.filter("ingredients", lambda x: x["grams_per_ml"].isNotNull())
    return recipe_details(spark, d).select(
        "id", "name", "is_editable", "is_mine", "is_queued", "cook_count", "provisional", "rating",
        F.size("ingredients").cast("bigint").alias("n_lines"), F.size(dense).cast("bigint").alias("n_dense"), F.round(F.aggregate(dense, F.lit(0.0), lambda a, x: a + x["grams_per_ml"]), 6).alias("density"),
        said("ingredients", lambda x: x["shown"], "|").alias("names"),
        F.array_join(F.transform(F.filter("steps", lambda s: s["is_heading"] == 0), lambda s: F.array_join(F.transform(s["spans"], lambda x: F.concat(x["t"], F.lit("="), x["text"])), "|")), "/").alias("spans"),
        said("photos", lambda p: F.concat(p["id"].cast("string"), F.coalesce(F.concat(F.lit("@"), p["cooked_on"]), F.lit("")), F.when(p["is_hero"], "*").otherwise("")), "|").alias("album"),
        F.size("annotations").cast("bigint").alias("n_annotations"),
    )


def _contents(spark: SparkSession, d: str, added: str | None = None) -> DataFrame:
    """(recipe_id, steps): the method of each recipe, headings read; ``added`` is a last step."""
    read = classify_step(F.col("text"))
    rows = view(spark, d, "method").select("recipe_id", F.struct("position", F.col("text").alias("order"), read["is_heading"].cast("int").alias("is_heading"), read["text"].alias("text")).alias("s"))
    return rows.groupBy("recipe_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("recipe_id", F.transform("s", lambda x, i: F.struct(i.alias("position"), x["is_heading"].alias("is_heading"), x["text"].alias("text"))).alias("steps"))


def _snapshot(steps_: Column) -> Column:
    recipe = F.struct(*(F.lit(None).cast("string").alias(f) for f in tracking.FIELDS))
    return tracking.snapshot(recipe, F.array().cast(f"array<{tracking._LINE}>"), steps_)


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """(recipe_id, old, new): of recipes with content a third lost the last content step, and a third got one more at the end."""
    rows = _contents(spark, d).where(F.exists("steps", lambda s: s["is_heading"] == 0))
    content = F.filter("steps", lambda s: s["is_heading"] == 0)
    last = F.try_element_at(content, F.lit(-1))["position"]
    fewer = F.filter("steps", lambda s: s["position"] != last)
    more = F.concat("steps", F.array(F.struct(F.size("steps").alias("position"), F.lit(0).alias("is_heading"), F.lit("Serve warm with basil leaves.").alias("text"))))
    return rows.select("recipe_id", _snapshot(F.col("steps")).alias("old"), _snapshot(F.when(F.col("recipe_id") % 3 == 1, fewer).when(F.col("recipe_id") % 3 == 2, more).otherwise(F.col("steps"))).alias("new"))


@query(
    with_views("recipes", "lines")
    + """, own AS (SELECT recipe_id, list(struct_pack(place := r - 1, "text" := raw_text, qty := qty, heading := is_heading = 1) ORDER BY r) AS l FROM
    (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY position, tiebreak) AS r FROM lines) GROUP BY recipe_id)
SELECT id, to_json(struct_pack(id := id, name := name, owner := owner, image := image, servings := servings, lines := coalesce(l, [])))::VARCHAR AS page FROM recipes LEFT JOIN own ON own.recipe_id = id"""
)
def s9_recipe_json(spark: SparkSession, d: str) -> DataFrame:
    """Each recipe with its lines in order as one JSON text, as a sink of pages writes it; nulls are kept."""
    lines = view(spark, d, "lines").groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "tiebreak", "raw_text", "qty", "is_heading"))).alias("l"))
    row = lambda x, i: F.struct(i.alias("place"), x["raw_text"].alias("text"), x["qty"].alias("qty"), (x["is_heading"] == 1).alias("heading"))
    none = F.array().cast("array<struct<place:int,text:string,qty:string,heading:boolean>>")
    pages = view(spark, d, "recipes").join(lines, "id", "left").select("id", "name", "owner", "image", "servings", F.coalesce(F.transform("l", row), none).alias("lines"))
    return pages.select("id", F.to_json(F.struct("id", "name", "owner", "image", "servings", "lines"), {"ignoreNullFields": "false"}).alias("page"))


_CONTENT = "content AS (SELECT recipe_id, count(*) AS n, arg_max(text, (position, text)) AS last FROM method WHERE shape NOT IN (5, 7) GROUP BY recipe_id)"


@query(
    with_views("method")
    + f""", {_CONTENT}
SELECT recipe_id, 'step' AS kind, n::INT AS new_pos, 'Serve warm with basil leaves.' AS added, NULL::VARCHAR AS removed FROM content WHERE recipe_id % 3 = 2
UNION ALL SELECT recipe_id, 'step', NULL, NULL, (n - 1)::VARCHAR || ':' || last FROM content WHERE recipe_id % 3 = 1"""
)
def c12_annotation_index(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees of the changes since a recipe's birth, by place; removed steps in old order."""
    placed, removed = kitchen.annotation_index(tracking.changes(_edited(spark, d)))
    gone = F.array_join(F.transform("removed", lambda r: F.concat(r["old_pos"].cast("string"), F.lit(":"), r["text"])), "|")
    none = F.lit(None)
    return placed.select("recipe_id", "kind", "new_pos", "added", none.cast("string").alias("removed")).unionByName(removed.select("recipe_id", "kind", none.cast("int").alias("new_pos"), none.cast("string").alias("added"), gone.alias("removed")))


@query(
    with_views("method", "cook_log", "recipes")
    + """, held AS (SELECT DISTINCT recipe_id FROM method)
SELECT c.recipe_id, 'cook' AS reason, c.id AS cook_log_id, c.user_id, true AS has_content FROM cook_log c JOIN held USING (recipe_id)
UNION ALL SELECT id, 'original', NULL, owner, true FROM recipes JOIN held ON held.recipe_id = id WHERE owner IS NOT NULL AND id % 4 <> 0"""
)
def c11_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots to take: one for each cook, and the original of owned recipes that have none."""
    contents = _contents(spark, d).select("recipe_id", _snapshot(F.col("steps")).alias("content"))
    recipes = view(spark, d, "recipes")
    have = recipes.where("id % 4 = 0").select(F.col("id").alias("recipe_id"), F.lit("original").alias("reason"))
    born = recipes.where("owner IS NOT NULL").select(F.col("id").alias("recipe_id"), F.col("owner").alias("user_id"))
    taken = kitchen.capture_snapshots(contents, view(spark, d, "cook_log"), have, born)
    return taken.select("recipe_id", "reason", "cook_log_id", "user_id", (F.length("content") > 2).alias("has_content"))


_READ = answers("recipe_pages", "id, url, shape", PAGES, PAGE_FIELDS, dict.fromkeys(("n_lines", "n_flagged", "n_steps", "n_headings"), "BIGINT"))
# the library already has the pages of the first orders, and the slug pie-co-1
_KNOWN = "id % 7 = 0"
_SITE = "regexp_extract(url, '//www\\.([^?]*)', 1)"


@query(with_views("recipe_pages") + f", told AS ({_READ}) SELECT id, {', '.join(PAGE_FIELDS)} FROM told")
def n6_read_recipe_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of known shapes read to records, lines and steps."""
    records = checkpoint(imports.read(view(spark, d, "recipe_pages").select("id", "url", "text")))
    found = imports.classified(records).groupBy("id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("l.kind") == "flagged").alias("n_flagged"))
    method = imports.step_rows(records).groupBy("id").agg(F.count("*").alias("n_steps"), F.sum("is_heading").alias("n_headings"))
    from larder.functions.lines import parse_servings

    joined = records.join(found, "id", "left").join(method, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("id", "refusal", "name", "source", parse_servings(F.col("servings_raw")).cast("string").alias("servings"), F.nullif("prep_time", F.lit("")).alias("prep_time"), text.joined_tags(F.col("categories")).alias("category"), zero("n_lines"), zero("n_flagged"), zero("n_steps"), zero("n_headings"))


@query(
    with_views("recipe_pages")
    + """SELECT id, CASE WHEN shape < 2 THEN 'json-ld' WHEN shape = 3 THEN 'named' END AS layer, CASE shape WHEN 0 THEN 'Pie & Co ' || id % 97 WHEN 1 THEN 'Cake ' || id % 89 WHEN 3 THEN 'Half' END AS name,
  CASE WHEN shape = 2 THEN 'NOT_A_RECIPE' WHEN shape > 3 THEN 'NO_STRUCTURED_DATA' END AS refusal,
  CASE shape WHEN 2 THEN 'json-ld:NOT_A_RECIPE|named:NO_NAME' WHEN 3 THEN 'json-ld:INCOMPLETE' WHEN 4 THEN 'json-ld:NO_STRUCTURED_DATA|named:NO_NAME' WHEN 5 THEN 'json-ld:NO_STRUCTURED_DATA|named:NO_NAME' ELSE '' END AS refusals FROM recipe_pages"""
)
def n6_layered_readers(spark: SparkSession, d: str) -> DataFrame:
    """Pages that the first reader refused go to a second, which takes any named thing; all refusals are kept."""

    def named(page: Column) -> Column:
        name = F.nullif(F.regexp_extract(page, r'"name"\s*:\s*"([^"]+)"', 1), F.lit(""))
        known = {"name": name, "refusal": F.when(name.isNull(), "NO_NAME")}
        return F.struct(*(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA.fields))

    found = imports.read(view(spark, d, "recipe_pages").select("id", "url", "text"), (*imports.LAYERS, ("named", named)))
    told = F.array_join(F.transform("refusals", lambda r: F.concat_ws(":", r["layer"], r["code"])), "|")
    return found.select("id", "layer", "name", "refusal", told.alias("refusals"))


_PLANNED = f"""based AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM told WHERE refusal IS NULL),
slugged AS (SELECT id, CASE WHEN base = 'pie-co-1' THEN base || '-' || (n + 1) WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM based)),
known AS (SELECT {_SITE} AS key, min(id) AS duplicate_of FROM recipe_pages WHERE {_KNOWN} GROUP BY 1)"""


@query(
    with_views("recipe_pages")
    + f""", told AS ({_READ}), {_PLANNED}
SELECT t.id, t.refusal, s.slug, t.name, t.servings, k.duplicate_of, CASE WHEN t.refusal IS NULL THEN t.n_lines END AS n_lines, CASE WHEN t.refusal IS NULL THEN t.n_steps END AS n_steps,
  CASE WHEN t.refusal IS NULL THEN 'imported_via' || CASE WHEN shape = 0 THEN '|ambiguous_section' ELSE '' END END AS flags
FROM told t LEFT JOIN slugged s USING (id) LEFT JOIN known k ON k.key = {_SITE.replace("url", "t.url")} AND t.refusal IS NULL"""
)
def q11_import_preview(spark: SparkSession, d: str) -> DataFrame:
    """What an import of each page would write, as nested rows told in brief."""
    source = view(spark, d, "recipe_pages").select("id", "url", "text")
    known = source.where(_KNOWN).select("id", urls.source_key(F.col("url")).alias("source_key"))
    taken = spark.range(1).select(F.lit("pie-co-1").alias("slug"))
    flags = F.array_join(F.array_sort(F.transform("review_flags", lambda f: F.struct(F.coalesce(f["position"], F.lit(-1)).alias("at"), f["flag"].alias("flag"))))["flag"], "|")
    shown = imports.preview(source, taken, known)
    return shown.select("id", "refusal", "slug", "name", "servings", "duplicate_of", *(F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint").alias(f"n_{n}") for c, n in (("ingredients", "lines"), ("steps", "steps"))), F.when(F.col("review_flags").isNotNull(), flags).alias("flags"))


@query(
    with_views("recipe_pages")
    + f""", told AS ({_READ}), {_PLANNED}, rows AS (SELECT s.slug, p.shape, p.n FROM slugged s JOIN recipe_pages p USING (id))
SELECT 'recipe_ingredients' AS tbl, slug AS recipe_id, pos::INT AS position, h::INT AS is_heading, qty, raw AS text, grams::DOUBLE AS grams FROM (
  SELECT slug, 0 AS pos, 0 AS h, n || ' cups' AS qty, n || ' cups flour' AS raw, NULL AS grams FROM rows WHERE shape = 0 UNION ALL SELECT slug, 1, 1, NULL, 'SAUCE:', NULL FROM rows WHERE shape = 0
  UNION ALL SELECT slug, 2, 0, NULL, 'salt', NULL FROM rows WHERE shape = 0 UNION ALL SELECT slug, 3, 0, n || ' cup', n || ' cup (' || n * 10 || 'g) dried beans', n * 10 FROM rows WHERE shape = 0
  UNION ALL SELECT slug, 0, 0, n::VARCHAR, n || ' eggs', NULL FROM rows WHERE shape = 1 UNION ALL SELECT slug, 1, 0, '½ cup', '½ cup sugar', NULL FROM rows WHERE shape = 1)
UNION ALL SELECT 'recipe_steps', slug, pos, h, NULL, t, NULL FROM (
  SELECT slug, 0 AS pos, 0 AS h, 'Bake at 350°F for ' || n || ' minutes.' AS t FROM rows WHERE shape = 0 UNION ALL SELECT slug, 1, 1, 'Crust:' FROM rows WHERE shape = 0 UNION ALL SELECT slug, 2, 0, 'Roll.' FROM rows WHERE shape = 0
  UNION ALL SELECT slug, 0, 0, 'Mix.' FROM rows WHERE shape = 1 UNION ALL SELECT slug, 1, 1, 'Serve' FROM rows WHERE shape = 1)
UNION ALL SELECT 'import_flags', slug, p, NULL, NULL, f, NULL FROM (SELECT slug, NULL::INT AS p, 'imported_via: json-ld' AS f FROM rows UNION ALL SELECT slug, 2, 'ambiguous_section: no amount and not clearly a section — suggest ingredient' FROM rows WHERE shape = 0)
UNION ALL SELECT 'recipes', s.slug, NULL, NULL, NULL, b.name, NULL FROM slugged s JOIN based b USING (id)"""
)
def q17_import_commit(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a commit of all pages stages, by table."""
    tables = imports.staged(view(spark, d, "recipe_pages").select("id", "url", "text"), spark.range(1).select(F.lit("pie-co-1").alias("slug")), ME)
    null = F.lit(None)
    columns = lambda df, name, position, heading, qty, words, grams: df.select(F.lit(name).alias("tbl"), df["id" if name == "recipes" else "recipe_id"].alias("recipe_id"), position.cast("int").alias("position"), heading.cast("int").alias("is_heading"), qty.cast("string").alias("qty"), words.alias("text"), grams.cast("double").alias("grams"))
    at, head = F.col("position"), F.col("is_heading")
    out = columns(tables["recipe_ingredients"], "recipe_ingredients", at, head, F.col("qty"), F.col("raw_text"), F.col("grams"))
    out = out.unionByName(columns(tables["recipe_steps"], "recipe_steps", at, head, null, F.col("text"), null))
    out = out.unionByName(columns(tables["import_flags"], "import_flags", at, null, null, F.concat_ws(": ", "flag", "reason"), null))
    return out.unionByName(columns(tables["recipes"], "recipes", null, null, null, F.col("name"), null))


_REQUESTS = """requests AS (SELECT event_id AS id, event_id * 7 % 400 AS recipe_id, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 400 * 0 + user_id ELSE user_id END AS user_id,
  CASE WHEN event_id % 3 = 1 THEN event_id - event_id % 5 END AS cook_log_id, repeat('c', (event_id % 62)::INT) AS caption, 'img/' || event_id % 40 AS path FROM events WHERE event_type = 'click')"""


@query(
    with_views("recipes", "cook_log", "photos")
    + f""", {_REQUESTS},
judged AS (SELECT q.id, q.recipe_id, nullif(q.caption, '') AS caption, r.owner = q.user_id AND r.image IS NULL AS may_lead,
    CASE WHEN length(q.caption) > 60 THEN 'caption too long' WHEN r.id IS NULL THEN 'recipe not found' WHEN q.cook_log_id IS NOT NULL AND (c.id IS NULL OR c.recipe_id <> q.recipe_id) THEN 'cook not found for this recipe'
      WHEN q.cook_log_id IS NOT NULL AND c.user_id <> q.user_id THEN 'not your cook' WHEN q.cook_log_id IS NULL AND (r.owner IS NULL OR r.owner <> q.user_id) THEN 'not your recipe' END AS refusal
  FROM requests q LEFT JOIN recipes r ON r.id = q.recipe_id LEFT JOIN cook_log c ON c.id = q.cook_log_id),
good AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY id) AS nth, min(CASE WHEN may_lead THEN id END) OVER (PARTITION BY recipe_id) AS hero FROM judged WHERE refusal IS NULL)
SELECT g.id, g.recipe_id, g.refusal, g.caption, coalesce((SELECT max(position) FROM photos p WHERE p.recipe_id = g.recipe_id), -1)::BIGINT + nth AS position, coalesce(hero = g.id, false) AS is_hero FROM good g
UNION ALL SELECT id, recipe_id, refusal, NULL, NULL, false FROM judged WHERE refusal IS NOT NULL"""
)
def d27_photo_attach(spark: SparkSession, d: str) -> DataFrame:
    """A batch of photos with captions of many lengths, for cooks and for albums."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'")
    requests = e.select(F.col("event_id").alias("id"), (F.col("event_id") * 7 % 400).alias("recipe_id"), "user_id", F.when(F.col("event_id") % 3 == 1, F.col("event_id") - F.col("event_id") % 5).alias("cook_log_id"), F.expr("repeat('c', cast(event_id % 62 AS int))").alias("caption"), F.concat(F.lit("img/"), (F.col("event_id") % 40).cast("string")).alias("path"))
    return kitchen.attach_photos(requests, view(spark, d, "recipes"), view(spark, d, "cook_log"), view(spark, d, "photos"))


@query(
    with_views("recipes", "photos")
    + """, gone AS (SELECT * FROM photos WHERE id % 6 = 0), rest AS (SELECT * FROM photos WHERE id % 6 <> 0)
SELECT (SELECT count(*) FROM rest) AS photos_left, (SELECT count(*) FROM recipes r WHERE image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.recipe_id = r.id AND g.path = r.image)) AS heroes_left,
  (SELECT count(*) FROM recipes r WHERE image IS NOT NULL AND EXISTS (SELECT 1 FROM gone g WHERE g.recipe_id = r.id AND g.path = r.image)) AS heroes_cleared,
  (SELECT count(DISTINCT path) FROM gone g WHERE path NOT IN (SELECT path FROM rest) AND path NOT IN (SELECT image FROM recipes r WHERE image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone h WHERE h.recipe_id = r.id AND h.path = r.image))) AS free_files"""
)
def d27_photo_delete(spark: SparkSession, d: str) -> DataFrame:
    """Owners delete every sixth photo; others' requests change nothing."""
    photos, recipes = view(spark, d, "photos"), view(spark, d, "recipes")
    asked = photos.where("id % 6 = 0").select(F.col("id").alias("photo_id"), "user_id").unionByName(photos.where("id % 6 = 1").select(F.col("id").alias("photo_id"), (F.col("user_id") + 1).alias("user_id")))
    left, cleared, free = kitchen.delete_photos(asked, photos, recipes)
    before = recipes.agg(F.count("image").alias("n"))
    one = left.agg(F.count("*").alias("photos_left")).crossJoin(cleared.agg(F.count("image").alias("heroes_left"))).crossJoin(before).crossJoin(free.agg(F.count("*").alias("free_files")))
    return one.select("photos_left", "heroes_left", (F.col("n") - F.col("heroes_left")).alias("heroes_cleared"), "free_files")


@query(
    with_views("quantities")
    + f"SELECT recipe_id, position, text AS qty, CASE WHEN position % 3 = 0 THEN 'kept' ELSE {chosen('shape', QUANTITIES, 'quantity', 'NULL').replace('AS string)', 'AS varchar)')} END AS quantity, CASE WHEN position % 3 = 0 THEN 'whole' ELSE {chosen('shape', QUANTITIES, 'unit', 'NULL')} END AS unit FROM quantities WHERE position > 1 UNION ALL SELECT recipe_id, position, text, CASE WHEN position % 3 = 0 THEN 'kept' END, CASE WHEN position % 3 = 0 THEN 'whole' END FROM quantities WHERE position <= 1"
)
def d30_quantity_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Lines without parts get them from their text; those with parts, and headings, stay."""
    given = F.col("position") % 3 == 0
    rows = view(spark, d, "quantities").select("recipe_id", "position", F.col("text").alias("qty"), F.when(given, "kept").alias("quantity"), F.when(given, "whole").alias("unit"), (F.col("position") == 1).cast("int").alias("is_heading"))
    return kitchen.backfill_parts(rows).drop("is_heading")


@query(
    with_views("lines")
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY recipe_id ORDER BY position, tiebreak) - 1 AS place FROM lines)
SELECT recipe_id, place::INT AS position, is_heading, CASE WHEN is_heading = 0 THEN qty END AS qty, CASE WHEN is_heading = 0 THEN CASE WHEN qty LIKE '% 1/2 tsp' THEN replace(qty, ' tsp', '') ELSE regexp_extract(qty, '^[0-9]+') END END AS quantity,
  CASE WHEN is_heading = 0 THEN CASE WHEN qty LIKE '% 1/2 tsp' THEN 'tsp' ELSE regexp_extract(qty, '^[0-9]+ ?([a-z]*)$', 1) END END AS unit, ingredient_id::VARCHAR AS ingredient_id,
  CASE WHEN is_heading = 1 THEN raw_text WHEN ingredient_id IS NOT NULL THEN trim(qty || ' ' || coalesce(label, '')) ELSE raw_text END AS raw_text FROM placed"""
)
def d33_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Headings, linked items and plain lines of seed recipes as rows."""
    entry = F.struct(
        F.when(F.col("is_heading") == 1, F.col("raw_text")).alias("heading"), F.when(F.col("is_heading") == 0, F.col("ingredient_id").cast("string")).alias("item"),
        "qty", "label", F.lit(None).cast("string").alias("note"), F.col("raw_text").alias("text"),
    )
    rows = view(spark, d, "lines").select("recipe_id", F.struct("position", "tiebreak", entry.alias("e")).alias("s")).groupBy("recipe_id").agg(F.array_sort(F.collect_list("s"))["e"].alias("ingredients"))
    return kitchen.seed_rows(rows).drop("label", "note")


_DATES = "CASE event_id % 5 WHEN 0 THEN substring(cast(ts AS varchar), 1, 10) WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'soon' WHEN 3 THEN '2031-05-01' END"


@query(
    with_views("recipes")
    + f""", requests AS (SELECT event_id AS id, event_id * 11 % 700 AS recipe_id, user_id, {_DATES} AS date FROM events WHERE event_type = 'purchase')
SELECT q.id, q.recipe_id, q.user_id, CASE WHEN refusal IS NULL THEN coalesce(date, '{TODAY}') END AS cooked_on, refusal FROM (SELECT q.*, CASE WHEN date IS NOT NULL AND try_cast(date AS DATE) IS NULL THEN 'not a date'
  WHEN try_cast(date AS DATE) > DATE '{TODAY}' THEN 'in the future' WHEN NOT EXISTS (SELECT 1 FROM recipes r WHERE r.id = q.recipe_id) THEN 'recipe not found' END AS refusal FROM requests q) q"""
)
def d10_cook_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Cooks with good, impossible, unreadable, future and no dates."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    date = F.when(F.col("event_id") % 5 == 0, F.substring(F.col("ts").cast("string"), 1, 10)).when(F.col("event_id") % 5 == 1, "2024-02-30").when(F.col("event_id") % 5 == 2, "soon").when(F.col("event_id") % 5 == 3, "2031-05-01")
    return kitchen.insert_cooks(e.select(F.col("event_id").alias("id"), (F.col("event_id") * 11 % 700).alias("recipe_id"), "user_id", date.alias("date")), view(spark, d, "recipes"), TODAY)


_LINKED = "linked AS (SELECT l_orderkey AS recipe_id, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey + CASE WHEN l_suppkey % 9 = 0 THEN 10000000 ELSE 0 END)::VARCHAR END AS item, 'Add [[' || l_partkey || '|it]] and [[ x' || l_suppkey % 3 || ' ]]' AS text FROM lineitem)"
_BROKEN = "broken AS (SELECT recipe_id, item AS key, 'line' AS place FROM linked WHERE item IS NOT NULL AND item NOT IN (SELECT id::VARCHAR FROM ingredients) UNION ALL SELECT recipe_id, trim(replace(replace(regexp_extract(text, '\\[\\[ x.*\\]\\]'), '[[', ''), ']]', '')), 'step' FROM linked WHERE item IS NULL AND NOT text LIKE '%[[ x0 ]]')"


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    item = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") + F.when(F.col("l_suppkey") % 9 == 0, 10_000_000).otherwise(0)).cast("string"))
    words = F.concat(F.lit("Add [["), F.col("l_partkey").cast("string"), F.lit("|it]] and [[ x"), (F.col("l_suppkey") % 3).cast("string"), F.lit(" ]]"))
    known = view(spark, d, "ingredients").select(F.col("id").cast("string").alias("id")).unionByName(spark.range(1).select(F.lit("x0").alias("id")))
    return kitchen.broken_links(rows.select(F.col("l_orderkey").alias("recipe_id"), item.alias("item"), words.alias("text")), known)


@query(with_views("ingredients") + f", {_LINKED}, {_BROKEN} SELECT recipe_id, key, place FROM broken")
def j19_broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Linked items, and every link in a step, that the library doesn't have."""
    return _links(spark, d)


@query(
    with_views("ingredients", "recipes")
    + f""", {_LINKED}, {_BROKEN}, requests AS (SELECT id, CASE WHEN id % 50 = 0 THEN '!!' ELSE name || ' ' || id % 300 END AS name, source = 'test' AS is_test FROM recipes),
slugged AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS slug FROM requests),
judged AS (SELECT *, CASE WHEN id IN (SELECT recipe_id FROM broken WHERE place = 'line') THEN 'broken link' WHEN slug = '' THEN 'no slug' WHEN ends_with(slug, '-7') THEN 'slug taken' END AS early FROM slugged),
firsts AS (SELECT slug, min(id) AS first FROM judged WHERE early IS NULL GROUP BY slug)
SELECT id, CASE WHEN early IS NULL AND first = id THEN slug END AS slug, CASE WHEN is_test THEN 'test' ELSE 'app' END AS source, coalesce(early, CASE WHEN first <> id THEN 'slug taken' END) AS refusal FROM judged LEFT JOIN firsts USING (slug)"""
)
def d23_created_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Created recipes with valid links and a free slug; of one slug the first gets it."""
    recipes = view(spark, d, "recipes")
    name = F.when(F.col("id") % 50 == 0, "!!").otherwise(F.concat_ws(" ", "name", (F.col("id") % 300).cast("string")))
    requests = recipes.select("id", F.col("id").alias("recipe_id"), name.alias("name"), (F.col("source") == "test").alias("is_test"))
    taken = requests.select(text.slug(F.col("name")).alias("id")).where("id LIKE '%-7'").distinct()
    return kitchen.create_recipes(requests, taken, _links(spark, d).where("place = 'line'"))


@query(with_views("queue_log") + "SELECT DISTINCT user_id, recipe_id FROM queue_log WHERE NOT (user_id % 4 = 1 AND recipe_id % 2 = 0)")
def d26_queue_removed(spark: SparkSession, d: str) -> DataFrame:
    """Removals by user and recipe; those of rows that aren't there change nothing."""
    rows = queue(spark, d).select("user_id", "recipe_id")
    asked = rows.where("user_id % 4 = 1 AND recipe_id % 2 = 0").unionByName(rows.select((F.col("user_id") + 1_000_000).alias("user_id"), "recipe_id"))
    return rows.join(asked.distinct(), ["user_id", "recipe_id"], "left_anti")


@query(
    with_views("recipes")
    + """, picked AS (SELECT id, arg_min(reason, spot) AS reason, min(spot) AS spot FROM (SELECT min(id) AS id, 'urgent' AS reason, 0 AS spot FROM recipes WHERE category LIKE '%URGENT%' UNION ALL SELECT min(id), 'no image', 1 FROM recipes WHERE image IS NULL
  UNION ALL SELECT min(id), 'no author', 2 FROM recipes WHERE author = '' UNION ALL SELECT min(id), 'none', 3 FROM recipes WHERE id < 0) WHERE id IS NOT NULL GROUP BY id),
drawn AS (SELECT id, 'random' AS reason, 100 + row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) AS spot FROM recipes WHERE id NOT IN (SELECT id FROM picked))
SELECT id, reason FROM (SELECT id, reason, spot FROM picked UNION ALL SELECT id, reason, spot FROM drawn) ORDER BY spot LIMIT 9"""
)
def a18_varied_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first recipe of each predicate, then a seeded fill to nine."""
    predicates = [("urgent", F.col("category").like("%URGENT%")), ("no image", F.col("image").isNull()), ("no author", F.col("author") == ""), ("none", F.col("id") < 0)]
    return kitchen.varied_sample(view(spark, d, "recipes"), predicates)


@query(with_views("recipes") + "SELECT id, owner, nullif(regexp_extract(servings, '[0-9]+'), '')::INT AS base, row_number() OVER (PARTITION BY owner ORDER BY source = 'test', name, id)::BIGINT AS place FROM recipes WHERE owner IS NOT NULL")
def f43_servings_base(spark: SparkSession, d: str) -> DataFrame:
    """What the servings scale from, in each owner's list with test recipes last and the order of names kept."""
    rows = view(spark, d, "recipes").where("owner IS NOT NULL").select("id", "owner", "name", (F.col("source") == "test").alias("last"), kitchen.servings_base(F.col("servings")).alias("base"))
    return slugs.placed(rows, ["owner"], ["last", "name"], "id").select("id", "owner", "base", F.col("place").cast("bigint").alias("place"))


@query(with_views("recipe_pages") + f", told AS ({_READ}), {_PLANNED} SELECT id, slug FROM slugged")
def w7_import_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of many recipes with few names, numbered by ranges; one base is taken."""
    named = view(spark, d, "recipe_pages").where("shape < 2").select("id", F.concat_ws(" ", F.when(F.col("shape") == 0, "Pie & Co").otherwise("Cake"), F.when(F.col("shape") == 0, F.col("id") % 97).otherwise(F.col("id") % 89).cast("string")).alias("name"))
    minted = slugs.mint(named.select(F.col("id").alias("entry"), text.slug_base(F.col("name")).alias("base")), spark.range(1).select(F.lit("pie-co-1").alias("slug")))
    return minted.select(F.col("entry").alias("id"), "slug")


HOSTS = (("'localhost'", "true"), ("concat('10.', n, '.2.3')", "true"), ("concat('192.168.0.', n, ':80')", "true"), ("concat('172.', 16 + n % 16, '.0.1')", "true"), ("concat('172.', 32 + n % 16, '.0.1')", "false"), ("concat('8.8.8.', n)", "false"), ("'[::1]'", "true"), ("concat('169.254.1.', n)", "true"), ("concat('site', n, '.example')", "false"))
_HOSTED = f"hosted AS (SELECT o_orderkey AS id, concat('http://', {chosen('(o_orderkey % 9)', tuple((h.replace('n,', '(o_custkey % 200),').replace(', n)', ', o_custkey % 200)').replace('n % 16', 'o_custkey % 16'), {}) for h, _ in HOSTS))}, '/x') AS url, {chosen('(o_orderkey % 9)', tuple((private, {}) for _, private in HOSTS))} AS is_private FROM orders)"


@query(f"WITH {_HOSTED} SELECT id, is_private FROM hosted")
def f24_private_hosts(spark: SparkSession, d: str) -> DataFrame:
    """local, private, link-local and public hosts; the oracle knows each shape's answer."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("n"))
    host = F.expr(chosen("(id % 9)", tuple((h, {}) for h, _ in HOSTS)))
    return orders.select("id", urls.is_private_host(F.concat(F.lit("http://"), host, F.lit("/x"))).alias("is_private"))


@query(
    with_views("recipes", "photos")
    + """, named AS (SELECT recipe_id, 'img/' || id % 4001 AS path FROM photos), images AS (SELECT source, 'img/' || id % 4001 AS image FROM recipes WHERE image IS NOT NULL)
SELECT DISTINCT path FROM named p JOIN recipes r ON r.id = p.recipe_id WHERE r.source = 'test' AND path NOT IN (SELECT path FROM named p2 JOIN recipes r2 ON r2.id = p2.recipe_id WHERE r2.source <> 'test') AND path NOT IN (SELECT image FROM images WHERE source <> 'test')"""
)
def u5_free_files(spark: SparkSession, d: str) -> DataFrame:
    """As u5_all_unreferenced_files, over so many paths that some are free to delete."""
    from larder.plans.state import unreferenced

    named = view(spark, d, "photos").select("recipe_id", F.concat(F.lit("img/"), (F.col("id") % 4001).cast("string")).alias("path"))
    recipes = view(spark, d, "recipes").select("id", "source", F.when(F.col("image").isNotNull(), F.concat(F.lit("img/"), (F.col("id") % 4001).cast("string"))).alias("image"))
    return unreferenced(named, recipes, recipes)


@query(
    with_views("recipes", "lines", "cook_log", "photos")
    + """, told(metric, expected, actual) AS (SELECT 'recipes with lines', (SELECT count(*) FROM recipes), (SELECT count(DISTINCT recipe_id) FROM lines)
  UNION ALL SELECT 'lines of known recipes', (SELECT count(*) FROM lines), (SELECT count(*) FROM lines WHERE recipe_id IN (SELECT id FROM recipes))
  UNION ALL SELECT 'photos of known cooks', (SELECT count(*) FROM photos WHERE cook_log_id IS NOT NULL), (SELECT count(*) FROM photos WHERE cook_log_id IN (SELECT id FROM cook_log)))
SELECT metric, expected, actual, CASE WHEN expected = actual THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM told"""
)
def a19_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Totals that must agree, and whether they do."""
    recipes, lines, photos = view(spark, d, "recipes").select("id"), view(spark, d, "lines").select("recipe_id"), view(spark, d, "photos").where("cook_log_id IS NOT NULL").select("cook_log_id")
    total = lambda df, name: df.agg(F.count("*").alias(name))
    checks = (
        ("recipes with lines", recipes, lines.distinct()),
        ("lines of known recipes", lines, lines.join(recipes.withColumnRenamed("id", "recipe_id"), "recipe_id", "left_semi")),
        ("photos of known cooks", photos, photos.join(view(spark, d, "cook_log").select(F.col("id").alias("cook_log_id")), "cook_log_id", "left_semi")),
    )
    out = None
    for metric, expected, actual in checks:
        one = total(expected, "expected").crossJoin(total(actual, "actual")).select(F.lit(metric).alias("metric"), "expected", "actual", F.when(F.col("expected") == F.col("actual"), "MATCH").otherwise("MISMATCH").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
