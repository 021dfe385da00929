"""State changes as batches: cascades, backfills, carry-over, album order, and checks of keys.

Parquet tables have no MERGE, so every change is a new state computed from the old one and a log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.operators import closure
from larder.operators.rows import cascade, orphans
from larder.plans.reads import queue, ratings
from larder.plans.registry import query
from larder.plans.views import ME, view, with_views

#: The longest caption of a post.
CAPTION_MAX = 280


def unreferenced(photos: DataFrame, recipes: DataFrame, heroes: DataFrame) -> DataFrame:
    """(path) of files of test recipes that no other recipe has in its album, nor one of ``heroes`` as its image."""
    held = photos.select("recipe_id", "path").join(recipes.select(F.col("id").alias("recipe_id"), "source"), "recipe_id")
    survivors = held.where("source <> 'test'").select("path").unionByName(heroes.where("source <> 'test' AND image IS NOT NULL").select(F.col("image").alias("path")))
    return held.where("source = 'test'").select("path").distinct().join(survivors, "path", "left_anti")


_GONE = "recipes_gone AS (SELECT id FROM recipes WHERE source = 'test')"


@query(
    with_views("recipes", "lines", "cook_log", "photos")
    + f""", {_GONE}
SELECT 'lines' AS tbl, count(*) AS n FROM lines WHERE recipe_id NOT IN (SELECT id FROM recipes_gone)
UNION ALL SELECT 'cook_log', count(*) FROM cook_log WHERE recipe_id NOT IN (SELECT id FROM recipes_gone)
UNION ALL SELECT 'photos', count(*) FROM photos WHERE recipe_id NOT IN (SELECT id FROM recipes_gone)
UNION ALL SELECT 'recipes', count(*) FROM recipes WHERE source <> 'test'"""
)
def j17_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left in each table when the test tier goes with all that hangs on it."""
    recipes = view(spark, d, "recipes")
    gone = recipes.where("source = 'test'").select("id")
    out = recipes.where("source <> 'test'").agg(F.lit("recipes").alias("tbl"), F.count("*").alias("n"))
    for name in ("lines", "cook_log", "photos"):
        out = out.unionByName(cascade(view(spark, d, name).select("recipe_id"), gone, "recipe_id", "id").agg(F.lit(name).alias("tbl"), F.count("*").alias("n")))
    return out


#: Tables that go with a recipe, by the view that stands for each, with what makes a row of it go.
_CLOSED = {
    "ratings": ("rating_log", "recipe_id IN (FROM gone)"), "cook_log": ("cook_log", "recipe_id IN (FROM gone)"), "flags": ("flags", "recipe_id IN (FROM gone)"),
    "lines": ("lines", "recipe_id IN (FROM gone)"), "method": ("method", "recipe_id IN (FROM gone)"), "recipe_queue": ("queue_log", "recipe_id IN (FROM gone)"),
    "posts": ("posts", "coalesce(recipe_id IN (FROM gone), false) OR coalesce(cook_log_id IN (FROM gone_cooks), false)"),
    "photos": ("photos", "recipe_id IN (FROM gone) OR coalesce(cook_log_id IN (FROM gone_cooks), false)"),
    "snapshots": ("snapshot_log", "recipe_id IN (FROM gone) OR coalesce(cook_log_id IN (FROM gone_cooks), false)"),
    "comments": ("replies", "post_id IN (FROM gone_posts)"), "recipes": ("recipes", "id IN (FROM gone)"),
}


@query(
    with_views(*sorted({v for v, _ in _CLOSED.values()}))
    + """, gone AS (SELECT id FROM recipes WHERE source = 'test' AND id % 2 = 0 OR id % 7 = 0), gone_cooks AS (SELECT id FROM cook_log WHERE recipe_id IN (FROM gone)),
gone_posts AS (SELECT id FROM posts WHERE coalesce(recipe_id IN (FROM gone), false) OR coalesce(cook_log_id IN (FROM gone_cooks), false)) """
    + " UNION ALL ".join(f"SELECT '{name}' AS tbl, count(*) AS n_all, count(*) FILTER (NOT ({goes})) AS n_left FROM {source}" for name, (source, goes) in _CLOSED.items())
)
def j17_closure(spark: SparkSession, d: str) -> DataFrame:
    """Recipes go with all that hangs on them, on their cooks and on their posts; rows of each table before and after."""
    tables = {name: view(spark, d, source) for name, (source, _) in _CLOSED.items()}
    gone = tables["recipes"].where("source = 'test' AND id % 2 = 0 OR id % 7 = 0").select("id")
    left = closure.delete(tables, "recipes", gone)
    counted = [rows.agg(F.lit(name).alias("tbl"), F.lit(kind).alias("kind"), F.count("*").alias("n")) for name in tables for kind, rows in (("all", tables[name]), ("left", left[name]))]
    sizes = reduce(DataFrame.unionByName, counted).groupBy("tbl")
    return sizes.agg(F.max(F.when(F.col("kind") == "all", F.col("n"))).alias("n_all"), F.max(F.when(F.col("kind") == "left", F.col("n"))).alias("n_left"))


@query(
    with_views("recipes", "photos")
    + """SELECT DISTINCT path FROM photos p JOIN recipes r ON r.id = p.recipe_id WHERE r.source = 'test'
  AND path NOT IN (SELECT path FROM photos p2 JOIN recipes r2 ON r2.id = p2.recipe_id WHERE r2.source <> 'test')
  AND path NOT IN (SELECT image FROM recipes WHERE source <> 'test' AND image IS NOT NULL)"""
)
def u5_all_unreferenced_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of deleted recipes that no survivor names, in its album or as its hero."""
    recipes = view(spark, d, "recipes")
    return unreferenced(view(spark, d, "photos"), recipes, recipes)


@query(
    with_views("cook_log", "photos", "lines", "recipes", "ingredients")
    + """SELECT 'photos.cook_log_id' AS fk, count(*) AS n FROM photos WHERE cook_log_id IS NOT NULL AND cook_log_id NOT IN (SELECT id FROM cook_log)
UNION ALL SELECT 'lines.recipe_id', count(*) FROM lines WHERE recipe_id NOT IN (SELECT id FROM recipes)
UNION ALL SELECT 'lines.ingredient_id', count(*) FROM lines WHERE ingredient_id IS NOT NULL AND ingredient_id NOT IN (SELECT id FROM ingredients)"""
)
def j18_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key points nowhere, counted for each foreign key."""
    checks = (("photos", "cook_log_id", "cook_log"), ("lines", "recipe_id", "recipes"), ("lines", "ingredient_id", "ingredients"))
    out = None
    for child, key, parent in checks:
        part = orphans(view(spark, d, child).select(key), view(spark, d, parent), key, "id").agg(F.lit(f"{child}.{key}").alias("fk"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    with_views("recipes", "photos")
    + """SELECT r.id, r.image, coalesce((SELECT max(position) FROM photos p WHERE p.recipe_id = r.id), -1)::BIGINT + 1 AS position
FROM recipes r WHERE r.image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM photos p WHERE p.recipe_id = r.id AND p.path = r.image)"""
)
def j8_hero_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Heroes without an album row, and the position that each would be appended at."""
    photos = view(spark, d, "photos")
    top = photos.groupBy("recipe_id").agg(F.max("position").alias("top"))
    heroes = view(spark, d, "recipes").where("image IS NOT NULL").select("id", "image")
    placed = photos.select(F.col("recipe_id").alias("id"), F.col("path").alias("image"))
    missing = heroes.join(placed, ["id", "image"], "left_anti")
    return missing.join(top, F.col("id") == F.col("recipe_id"), "left").select("id", "image", (F.coalesce("top", F.lit(-1)) + 1).cast("bigint").alias("position"))


@query(
    with_views("photos", "cook_log")
    + """, dated AS (SELECT p.*, c.cooked_on FROM photos p LEFT JOIN cook_log c ON c.id = p.cook_log_id),
top AS (SELECT recipe_id, coalesce(max(position), -1) AS base FROM photos GROUP BY recipe_id)
SELECT d.id, d.recipe_id, (base + row_number() OVER (PARTITION BY d.recipe_id ORDER BY d.cooked_on IS NULL, d.cooked_on DESC, d.added_at DESC, d.id DESC))::BIGINT AS position
FROM dated d JOIN top t ON t.recipe_id = d.recipe_id WHERE d.position IS NULL"""
)
def w2_photo_positions(spark: SparkSession, d: str) -> DataFrame:
    """Unplaced photos follow the placed ones, dated first, newest first."""
    cooks = view(spark, d, "cook_log").select(F.col("id").alias("cook_log_id"), "cooked_on")
    photos = view(spark, d, "photos")
    base = photos.groupBy("recipe_id").agg(F.coalesce(F.max("position"), F.lit(-1)).alias("base"))
    order = Window.partitionBy("recipe_id").orderBy(F.col("cooked_on").isNull(), F.desc("cooked_on"), F.desc("added_at"), F.desc("id"))
    loose = photos.where("position IS NULL").join(cooks, "cook_log_id", "left").withColumn("n", F.row_number().over(order))
    return loose.join(base, "recipe_id").select("id", "recipe_id", (F.col("base") + F.col("n")).cast("bigint").alias("position"))


@query(
    with_views("cook_log", "rating_log")
    + """, ratings AS (SELECT recipe_id, user_id, rating FROM rating_log WHERE rating BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY recipe_id, user_id ORDER BY rated_on DESC, id DESC) = 1),
latest AS (SELECT recipe_id, user_id, max(id) AS id, count(*) AS n FROM cook_log GROUP BY recipe_id, user_id)
SELECT l.recipe_id, l.user_id, l.id AS undone, l.n - 1 AS cooks_left, CASE WHEN l.n > 1 THEN r.rating END AS rating_left
FROM latest l LEFT JOIN ratings r ON r.recipe_id = l.recipe_id AND r.user_id = l.user_id"""
)
def d8_undo_cook(spark: SparkSession, d: str) -> DataFrame:
    """Each user takes back the latest cook of each recipe, by id; without a cook left the rating goes."""
    latest = view(spark, d, "cook_log").groupBy("recipe_id", "user_id").agg(F.max("id").alias("undone"), F.count("*").alias("n"))
    joined = latest.join(ratings(spark, d).select("recipe_id", "user_id", "rating"), ["recipe_id", "user_id"], "left")
    return joined.select("recipe_id", "user_id", "undone", (F.col("n") - 1).alias("cooks_left"), F.when(F.col("n") > 1, F.col("rating")).alias("rating_left"))


@query(
    with_views("cook_log", "rating_log")
    + """, undone AS (SELECT max(id) AS id FROM cook_log GROUP BY recipe_id, user_id),
kept AS (SELECT id, recipe_id, user_id, cooked_on, source FROM cook_log WHERE id NOT IN (SELECT id FROM undone)),
redone AS (SELECT id + 1000000 AS id, recipe_id, user_id, cooked_on, source FROM cook_log WHERE id IN (SELECT id FROM undone))
SELECT recipe_id, user_id, count(*) AS cooks, max(id) AS newest FROM (SELECT * FROM kept UNION ALL SELECT * FROM redone) GROUP BY recipe_id, user_id"""
)
def d9_redo_cook(spark: SparkSession, d: str) -> DataFrame:
    """What was taken back comes again, as new rows with the same date and source."""
    log = view(spark, d, "cook_log")
    undone = log.groupBy("recipe_id", "user_id").agg(F.max("id").alias("id")).select("id")
    again = log.join(undone, "id", "left_semi").withColumn("id", F.col("id") + 1_000_000)
    return log.join(undone, "id", "left_anti").unionByName(again).groupBy("recipe_id", "user_id").agg(F.count("*").alias("cooks"), F.max("id").alias("newest"))


@query(
    with_views("lines")
    + """, old AS (SELECT recipe_id, lower(trim(qty)) AS q, lower(trim(raw_text)) AS n, arg_max(amount, (position, tiebreak)) AS grams FROM lines WHERE position < 5 GROUP BY 1, 2, 3)
SELECT l.recipe_id, l.position, l.tiebreak, o.grams FROM lines l LEFT JOIN old o ON o.recipe_id = l.recipe_id AND o.q = lower(trim(l.qty)) AND o.n = lower(trim(l.raw_text)) WHERE l.position >= 3"""
)
def d7_weight_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """An edited line keeps the weight of the old line with its amount and name; of duplicates the last."""
    key = {"q": F.lower(F.trim("qty")), "n": F.lower(F.trim("raw_text"))}
    lines = view(spark, d, "lines").withColumns(key)
    old = lines.where("position < 5").groupBy("recipe_id", "q", "n").agg(F.max_by("amount", F.struct("position", "tiebreak")).alias("grams"))
    return lines.where("position >= 3").join(old, ["recipe_id", "q", "n"], "left").select("recipe_id", "position", "tiebreak", "grams")


@query(
    with_views("recipes", "queue_log")
    + f""", recipe_queue AS (SELECT DISTINCT user_id, recipe_id FROM queue_log)
SELECT id, array_to_string(list_filter(string_split(category, '-'), lambda t: t <> 'URGENT'), '-') AS category FROM recipes r
WHERE list_contains(string_split(category, '-'), 'URGENT') AND NOT EXISTS (SELECT 1 FROM recipe_queue q WHERE q.recipe_id = r.id AND q.user_id = {ME})"""
)
def d18_tag_to_queue(spark: SparkSession, d: str) -> DataFrame:
    """Tagged recipes join a user's queue if they aren't in it, and lose the tag."""
    mine = queue(spark, d).where(F.col("user_id") == ME).select(F.col("recipe_id").alias("id"))
    tags = F.split("category", "-")
    tagged = view(spark, d, "recipes").where(F.array_contains(tags, "URGENT"))
    return tagged.join(mine, "id", "left_anti").select("id", F.array_join(F.array_remove(tags, "URGENT"), "-").alias("category"))


@query(with_views("recipes") + "SELECT count(*) FILTER (owner IS NULL) AS null_owner, count(*) FILTER (author = '') AS blank_author, count(*) FILTER (image IS NULL) AS null_image, (SELECT count(*) FROM recipes WHERE coalesce(owner, 3) = 3) AS owned_by_three FROM recipes")
def d21_owner_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Null audit, and how many rows a user owns once nulls are theirs."""
    return view(spark, d, "recipes").agg(
        F.count_if(F.col("owner").isNull()).alias("null_owner"), F.count_if(F.col("author") == "").alias("blank_author"), F.count_if(F.col("image").isNull()).alias("null_image"), F.count_if(F.coalesce("owner", F.lit(3)) == 3).alias("owned_by_three")
    )


@query(
    with_views("flags", "lines")
    + """SELECT l.recipe_id, l.position, l.tiebreak, f.flag IS NOT NULL AS promoted FROM lines l
LEFT JOIN (SELECT DISTINCT recipe_id, position, 'x' AS flag FROM flags WHERE reason LIKE '%suggest section%') f ON f.recipe_id = l.recipe_id AND f.position = l.position
WHERE l.ingredient_id IS NULL AND l.is_heading = 0"""
)
def d19_heading_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a flag at their place marks as headings."""
    marked = view(spark, d, "flags").where(F.col("reason").contains("suggest section")).select("recipe_id", "position", F.lit(True).alias("m")).distinct()
    lines = view(spark, d, "lines").where("ingredient_id IS NULL AND is_heading = 0")
    return lines.join(marked, ["recipe_id", "position"], "left").select("recipe_id", "position", "tiebreak", F.col("m").isNotNull().alias("promoted"))


@query(
    with_views("recipes", "lines")
    + """SELECT r.id + (SELECT max(id) FROM recipes) AS id, r.name || ' (copy 1)' AS name, r.owner % 149 + 1 AS owner, count(l.recipe_id) AS lines FROM recipes r LEFT JOIN lines l ON l.recipe_id = r.id WHERE r.owner IS NOT NULL GROUP BY r.id, r.name, r.owner"""
)
def d6_copy_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Copies of all owned recipes with their lines, for the next user, under new ids and names."""
    recipes = view(spark, d, "recipes").select("id", "name", "owner")
    lines = view(spark, d, "lines").groupBy(F.col("recipe_id").alias("id")).agg(F.count("*").alias("n"))
    source = recipes.where("owner IS NOT NULL").join(lines, "id", "left").withColumn("highest", recipes.agg(F.max("id")).scalar())
    return source.select((F.col("id") + F.col("highest")).alias("id"), F.concat("name", F.lit(" (copy 1)")).alias("name"), (F.col("owner") % 149 + 1).alias("owner"), F.coalesce("n", F.lit(0)).alias("lines"))


@query(
    with_views("ingredients")
    + """, base AS (SELECT id, name, '2023-01-01' AS created_at FROM ingredients WHERE id % 3 <> 0), seed AS (SELECT id, upper(name) AS name FROM ingredients WHERE id % 2 = 0)
SELECT coalesce(b.id, s.id) AS id, coalesce(s.name, b.name) AS name, coalesce(b.created_at, '2024-01-31') AS created_at FROM base b FULL JOIN seed s ON s.id = b.id"""
)
def d3_seed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows refresh the columns that may change, the first stamp of a row stays."""
    base = view(spark, d, "ingredients").where("id % 3 <> 0").select("id", F.col("name").alias("old"), F.lit("2023-01-01").alias("stamp"))
    seed = view(spark, d, "ingredients").where("id % 2 = 0").select("id", F.upper("name").alias("new"))
    return base.join(seed, "id", "full").select("id", F.coalesce("new", "old").alias("name"), F.coalesce("stamp", F.lit("2024-01-31")).alias("created_at"))


@query(
    with_views("recipes", "cook_log")
    + """SELECT id, source, EXISTS (SELECT 1 FROM cook_log c WHERE c.recipe_id = r.id AND c.source = 'import') AS seeded FROM recipes r
WHERE NOT EXISTS (SELECT 1 FROM cook_log c WHERE c.recipe_id = r.id AND c.source = 'app')"""
)
def d22_all_guarded_insert(spark: SparkSession, d: str) -> DataFrame:
    """All recipes that may get a seeded row: they exist, and none of that source is there."""
    return insertable(view(spark, d, "recipes"), view(spark, d, "cook_log"))


def insertable(recipes: DataFrame, cook_log: DataFrame) -> DataFrame:
    """(id, source, seeded) of recipes without a cook from the app; seeded if an import is there."""
    log = cook_log.select(F.col("recipe_id").alias("id"), "source")
    free = recipes.select("id", "source").join(log.where("source = 'app'").select("id"), "id", "left_anti")
    return free.join(log.where("source = 'import'").select("id", F.lit(True).alias("s")).distinct(), "id", "left").select("id", "source", F.col("s").isNotNull().alias("seeded"))


@query(
    with_views("recipes", "sources")
    + """, archive AS (SELECT 'u' || id AS uid, id % 4 AS kind FROM sources)
SELECT r.id, CASE WHEN a.uid IS NULL THEN 'missing in archive' WHEN kind = 0 THEN 'no-photo' WHEN kind = 1 THEN 'thumb-only' WHEN kind = 2 THEN 'failed' ELSE 'backfilled' END AS bucket
FROM recipes r LEFT JOIN archive a ON a.uid = r.uid WHERE r.source = 'app' AND r.image IS NULL AND r.uid <> ''"""
)
def d28_photo_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What the archive has for recipes without an image, by bucket."""
    archive = view(spark, d, "sources").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uid"), (F.col("id") % 4).alias("kind"))
    wanted = view(spark, d, "recipes").where("source = 'app' AND image IS NULL AND uid <> ''").select("id", "uid")
    names = F.when(F.col("kind").isNull(), "missing in archive").when(F.col("kind") == 0, "no-photo").when(F.col("kind") == 1, "thumb-only").when(F.col("kind") == 2, "failed").otherwise("backfilled")
    return wanted.join(archive, "uid", "left").select("id", names.alias("bucket"))


@query(
    with_views("recipes")
    + """SELECT id, uid, CASE WHEN uid <> '' AND row_number() OVER (PARTITION BY uid ORDER BY created_at, id) > 1 THEN 'skip' ELSE 'write' END AS decision FROM recipes"""
)
def w8_batch_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of a batch's entries with one uid the first is written; blank uids are all different.

    The first is a minimum by key, so that neither a common uid nor the blank one is gathered.
    """
    recipes = view(spark, d, "recipes").select("id", "uid", "created_at")
    first = recipes.where("uid <> ''").groupBy("uid").agg(F.min(F.struct("created_at", "id"))["id"].alias("first"))
    decision = F.when(F.col("first").isNotNull() & (F.col("first") != F.col("id")), "skip").otherwise("write")
    return recipes.join(first, "uid", "left").select("id", "uid", decision.alias("decision"))


@query(
    with_views("posts", "users")
    + f"""SELECT p.id, CASE WHEN length(trim(p.caption)) = 0 THEN NULL ELSE trim(p.caption) END AS caption, p.user_id = 7 OR (SELECT is_admin FROM users u WHERE u.id = p.user_id) AS may_delete FROM posts p WHERE p.caption IS NULL OR length(trim(p.caption)) <= {CAPTION_MAX}"""
)
def d13_all_share_rules(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed captions within the reference's cap, and who may delete."""
    return shared(view(spark, d, "posts"), view(spark, d, "users"), CAPTION_MAX)


def shared(posts: DataFrame, users: DataFrame, cap: int) -> DataFrame:
    """(id, caption, may_delete) of posts without a caption or with one of at most ``cap`` code points once trimmed."""
    users = users.select(F.col("id").alias("user_id"), "is_admin")
    caption = F.trim("caption")
    return posts.where(F.col("caption").isNull() | (F.length(caption) <= cap)).join(users, "user_id", "left").select("id", F.nullif(caption, F.lit("")).alias("caption"), ((F.col("user_id") == 7) | F.col("is_admin")).alias("may_delete"))


@query(
    with_views("recipes", "users")
    + """SELECT (SELECT count(DISTINCT owner) FROM recipes) > 1 AS ambiguous, (SELECT count(*) FROM (SELECT name FROM recipes WHERE source = 'app' EXCEPT SELECT name FROM recipes WHERE source = 'test')) AS difference,
  (SELECT count(*) FROM (SELECT owner FROM recipes UNION SELECT id FROM users)) AS together,
  NOT EXISTS (SELECT id FROM users EXCEPT SELECT owner FROM recipes) AND NOT EXISTS (SELECT owner FROM recipes EXCEPT SELECT id FROM users) AS equal"""
)
def u_all_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """The same on whole sides: names of the app tier beside the test tier's, owners beside users."""
    r = view(spark, d, "recipes").select("name", "owner", "source")
    users, owners = view(spark, d, "users").select("id"), r.select(F.col("owner").alias("id"))
    tier = lambda t: r.where(F.col("source") == t).select("name")
    a = r.agg((F.count_distinct("owner") > 1).alias("ambiguous"))
    b = tier("app").subtract(tier("test")).agg(F.count("*").alias("difference"))
    c = owners.union(users).distinct().agg(F.count("*").alias("together"))
    e = users.subtract(owners).unionByName(owners.subtract(users)).agg((F.count("*") == 0).alias("equal"))
    return a.crossJoin(b).crossJoin(c).crossJoin(e)


@query(
    with_views("photos")
    + """, sent AS (SELECT recipe_id, list(id ORDER BY id DESC) AS l, count(*) AS n FROM photos GROUP BY recipe_id),
given AS (SELECT recipe_id, CASE WHEN recipe_id % 5 = 0 THEN l[2:] ELSE l END AS l FROM sent), split AS (SELECT recipe_id, unnest(l) AS id, generate_subscripts(l, 1) - 1 AS place FROM given WHERE recipe_id % 5 <> 0)
SELECT p.id, p.recipe_id, coalesce(s.place, p.position)::BIGINT AS position FROM photos p LEFT JOIN split s ON s.id = p.id"""
)
def o9_reorder_album(spark: SparkSession, d: str) -> DataFrame:
    """A given order becomes the positions if it is exactly a permutation of the album; else nothing changes."""
    from larder.functions.names import is_permutation

    photos = view(spark, d, "photos").select("id", "recipe_id", "position")
    own = photos.groupBy("recipe_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))
    given = own.withColumn("order", F.when(F.col("recipe_id") % 5 == 0, F.slice("ids", 2, F.size("ids"))).otherwise(F.col("ids")))
    places = given.where(is_permutation(F.col("order"), F.col("ids"))).select(F.posexplode("order").alias("place", "id"))
    return photos.join(places, "id", "left").select("id", "recipe_id", F.coalesce("place", "position").cast("bigint").alias("position"))
