"""The smaller state changes as whole batches: friends, images, invites, dead pointers, ratings, owners, months."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import times
from larder.operators import kitchen
from larder.plans.reads import _FRIENDSHIPS, friendships
from larder.plans.registry import query
from larder.plans.views import view, with_views


@query(
    with_views("friend_log")
    + f""", {_FRIENDSHIPS}
SELECT requester, addressee, CASE WHEN addressee % 3 = 0 THEN 'accepted' ELSE status END AS status FROM friendships WHERE (requester + addressee) % 5 <> 0"""
)
def d12_changed_friends(spark: SparkSession, d: str) -> DataFrame:
    """Every third user accepts all requests made to them; pairs are removed by one side or the other; asking again changes nothing."""
    pairs = friendships(spark, d).select("requester", "addressee", "status")
    accepted = pairs.where("addressee % 3 = 0").select(F.col("addressee").alias("user_id"), F.col("requester").alias("friend")).unionByName(pairs.where("requester % 3 = 1").select(F.col("requester").alias("user_id"), F.col("addressee").alias("friend")))
    gone = pairs.where("(requester + addressee) % 5 = 0")
    swap = F.col("requester") % 2 == 0
    removed = gone.select(F.when(swap, F.col("addressee")).otherwise(F.col("requester")).alias("user_id"), F.when(swap, F.col("requester")).otherwise(F.col("addressee")).alias("friend"))
    return kitchen.change_friends(pairs, accepted, removed)


@query(
    with_views("recipes", "photos")
    + """, asked AS (SELECT p.recipe_id, arg_max(p.path, p.id) AS path FROM photos p JOIN recipes r ON r.id = p.recipe_id WHERE p.id % 3 = 0 AND r.owner = p.user_id + p.id % 2 GROUP BY 1)
SELECT r.id, coalesce(a.path, r.image) AS image FROM recipes r LEFT JOIN asked a ON a.recipe_id = r.id"""
)
def d15_promoted_photos(spark: SparkSession, d: str) -> DataFrame:
    """Images that owners chose from their albums; others' choices change nothing."""
    photos = view(spark, d, "photos")
    requests = photos.where("id % 3 = 0").select("id", F.col("id").alias("photo_id"), (F.col("user_id") + F.col("id") % 2).alias("user_id"))
    return kitchen.promote_photos(requests, photos, view(spark, d, "recipes").select("id", "owner", "image")).select("id", "image")


_ENDS = "CASE id % 4 WHEN 0 THEN '2024-01-10' WHEN 1 THEN '2024-02-10T08:30:00' WHEN 2 THEN 'soon' END"
_FIXED = "CASE id % 4 WHEN 0 THEN '2024-01-10 00:00:00' WHEN 1 THEN '2024-02-10 08:30:00' END"


@query(
    with_views("users")
    + f""", invites AS (SELECT 'code-' || id AS code, id % 5 = 0 AS used, {_FIXED} AS expires_at FROM users WHERE id % 4 <> 2), signups AS (SELECT event_id AS id, 'code-' || user_id AS code, substring(ts::VARCHAR, 1, 19) AS moment FROM events WHERE event_type = 'view'),
judged AS (SELECT s.*, CASE WHEN i.code IS NULL THEN 'no such invite' WHEN used THEN 'used' WHEN expires_at <= s.moment THEN 'expired' END AS early FROM signups s LEFT JOIN invites i USING (code))
SELECT id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY code, early IS NULL ORDER BY moment, id) > 1 THEN 'used' END) AS refusal FROM judged"""
)
def d16_signups(spark: SparkSession, d: str) -> DataFrame:
    """Signups against invites; an end that is no time makes no invite."""
    raw = F.expr(_ENDS)
    invites = view(spark, d, "users").select(F.concat(F.lit("code-"), F.col("id").cast("string")).alias("code"), (F.col("id") % 5 == 0).alias("used"), raw.alias("raw"), times.expiry(raw).alias("expires_at"))
    invites = invites.where("raw IS NULL OR expires_at IS NOT NULL").drop("raw")
    signups = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.concat(F.lit("code-"), F.col("user_id").cast("string")).alias("code"), F.substring(F.col("ts").cast("string"), 1, 19).alias("at"))
    return kitchen.consume_invites(signups, invites)


@query(with_views("recipes") + "SELECT id, CASE WHEN id % 2 = 0 AND (id % 40) % 3 = 0 THEN NULL ELSE image END AS image FROM recipes WHERE image IS NOT NULL")
def d29_dead_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Images that are no file go, of the recipes on a list."""
    recipes = view(spark, d, "recipes").where("image IS NOT NULL").select("id", "image")
    files = spark.range(40).where("id % 3 <> 0").select(F.concat(F.lit("img/"), F.col("id").cast("string")).alias("path"))
    return kitchen.null_dead_pointers(recipes, recipes.where("id % 2 = 0").select("id"), files)


@query(
    with_views("recipes")
    + """, requests AS (SELECT event_id AS id, event_id * 7 % 600 AS recipe_id, user_id, substring(ts::VARCHAR, 1, 10) AS day, CASE WHEN event_id % 4 > 0 THEN event_id % 8 END AS rating, event_id % 3 = 0 AS cooks FROM events WHERE event_type = 'click'),
known AS (SELECT * FROM requests WHERE recipe_id IN (SELECT id FROM recipes) AND (rating IS NULL OR rating BETWEEN 1 AND 5)), cooked AS (SELECT recipe_id, user_id, count(*) AS n FROM known WHERE cooks GROUP BY 1, 2),
rated AS (SELECT recipe_id, user_id, arg_max(rating, id) AS rating, arg_max(day, id) AS rated_on FROM known WHERE rating IS NOT NULL GROUP BY 1, 2)
SELECT recipe_id, user_id, coalesce(n, 0)::BIGINT AS cooks, rating::BIGINT AS rating, rated_on FROM cooked FULL JOIN rated USING (recipe_id, user_id)"""
)
def d25_cooks_and_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Cooks that rate, ratings alone, and what is refused."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'")
    n = F.col("event_id")
    requests = e.select(n.alias("id"), (n * 7 % 600).alias("recipe_id"), "user_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("on"), F.when(n % 4 > 0, n % 8).alias("rating"), (n % 3 == 0).alias("cooks"))
    cooks, rated = kitchen.cook_and_rate(requests, view(spark, d, "recipes"))
    counted = cooks.groupBy("recipe_id", "user_id").agg(F.count("*").alias("cooks"))
    return counted.join(rated, ["recipe_id", "user_id"], "full").select("recipe_id", "user_id", F.coalesce("cooks", F.lit(0)).cast("bigint").alias("cooks"), F.col("rating").cast("bigint").alias("rating"), "rated_on")


@query(with_views("users") + "SELECT id FROM users WHERE lower(trim(email)) = 'customer#000000009@example.org'")
def d35_owner(spark: SparkSession, d: str) -> DataFrame:
    """The owner named by an address."""
    return kitchen.resolve_owner(view(spark, d, "users"), " Customer#000000009@example.org ")


def in_season(spark: SparkSession, d: str, month: int | None = None) -> DataFrame:
    """(id, name, month) of ingredients in season in a month; none means the month of today."""
    month = month or datetime.datetime.now(datetime.UTC).month
    seasons = view(spark, d, "lines").where("ingredient_id IS NOT NULL").where(F.col("month") == month).select(F.col("ingredient_id").alias("id"), F.col("month").cast("bigint").alias("month")).distinct()
    return view(spark, d, "ingredients").select("id", "name").join(seasons, "id")


@query(with_views("ingredients", "lines") + ", seasons AS (SELECT DISTINCT ingredient_id, month FROM lines WHERE ingredient_id IS NOT NULL) SELECT month::BIGINT AS asked, id, name FROM seasons JOIN ingredients ON id = ingredient_id WHERE month IN (2, 11)")
def q5_asked_months(spark: SparkSession, d: str) -> DataFrame:
    """The same for given months."""
    return in_season(spark, d, 2).unionByName(in_season(spark, d, 11)).select(F.col("month").alias("asked"), "id", "name")
