"""Read model: lists, details, per-user statistics, queue, friends, feed, album, invites.

All per-user questions are answered for all users at once where the result allows, from one
aggregate per table and key; a single user's answer is a filter on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.operators.rows import by_name, keep_first, keep_last, newest, rebuild_changes, symmetric
from larder.plans.registry import query
from larder.plans.views import ME, NOW, view, with_views

CUTOFF = "2024-01-17 00:00:00"  # NOW less fourteen days
FEED_ROWS = 50


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """The state of the rating log: values 1 to 5, the last of a recipe and user wins."""
    return keep_last(view(spark, d, "rating_log").where("rating BETWEEN 1 AND 5"), ["recipe_id", "user_id"], ["rated_on", "id"])


def queue(spark: SparkSession, d: str) -> DataFrame:
    """The state of the queue log: the first time that a user added a recipe."""
    return keep_first(view(spark, d, "queue_log"), ["user_id", "recipe_id"], ["added_at", "id"])


def friendships(spark: SparkSession, d: str) -> DataFrame:
    """One row per unordered pair: accepted once both have asked, or if any request was accepted."""
    log = view(spark, d, "friend_log").withColumns({"lo": F.least("requester", "addressee"), "hi": F.greatest("requester", "addressee")})
    folded = log.groupBy("lo", "hi").agg(
        F.min(F.struct("created_at", "id", "requester", "addressee")).alias("first"),
        F.count_distinct("requester").alias("sides"),
        F.max((F.col("status") == "accepted").cast("int")).alias("said"),
    )
    return folded.select(F.col("first.requester").alias("requester"), F.col("first.addressee").alias("addressee"), F.col("first.created_at").alias("created_at"), F.when((F.col("sides") == 2) | (F.col("said") == 1), "accepted").otherwise("pending").alias("status"))


_RATINGS = """ratings AS (
  SELECT recipe_id, user_id, rating, rated_on FROM rating_log WHERE rating BETWEEN 1 AND 5
  QUALIFY row_number() OVER (PARTITION BY recipe_id, user_id ORDER BY rated_on DESC, id DESC) = 1)"""
_QUEUE = """recipe_queue AS (
  SELECT id, user_id, recipe_id, added_at FROM queue_log QUALIFY row_number() OVER (PARTITION BY user_id, recipe_id ORDER BY added_at, id) = 1)"""
_FRIENDSHIPS = """friendships AS (
  SELECT f.requester, f.addressee, f.created_at, CASE WHEN EXISTS (
      SELECT 1 FROM friend_log g WHERE (g.requester = f.requester AND g.addressee = f.addressee AND g.status = 'accepted')
        OR (g.requester = f.addressee AND g.addressee = f.requester)) THEN 'accepted' ELSE 'pending' END AS status
  FROM friend_log f QUALIFY row_number() OVER (PARTITION BY least(requester, addressee), greatest(requester, addressee) ORDER BY created_at, id) = 1)"""


@query(
    with_views("recipes", "cook_log", "rating_log", "queue_log")
    + f""", {_RATINGS}, {_QUEUE}
SELECT r.id, r.name, r.source, coalesce(r.owner = {ME}, false) AS is_mine,
  (SELECT rating FROM ratings t WHERE t.recipe_id = r.id AND t.user_id = {ME}) AS rating,
  (SELECT count(*) FROM cook_log c WHERE c.recipe_id = r.id AND c.user_id = {ME}) AS cook_count,
  (SELECT max(cooked_on) FROM cook_log c WHERE c.recipe_id = r.id AND c.user_id = {ME}) AS last_cooked,
  EXISTS (SELECT 1 FROM recipe_queue q WHERE q.recipe_id = r.id AND q.user_id = {ME}) AS is_queued
FROM recipes r"""
)
def q1_recipe_list(spark: SparkSession, d: str) -> DataFrame:
    """Every recipe with one user's rating, cooks and queue mark."""
    mine = F.col("user_id") == ME
    cooks = view(spark, d, "cook_log").where(mine).groupBy("recipe_id").agg(F.count("*").alias("n"), F.max("cooked_on").alias("last_cooked"))
    rated = ratings(spark, d).where(mine).select("recipe_id", "rating")
    queued = queue(spark, d).where(mine).select("recipe_id", F.lit(True).alias("queued"))
    recipes = view(spark, d, "recipes").withColumnRenamed("id", "recipe_id")
    joined = recipes.join(cooks, "recipe_id", "left").join(rated, "recipe_id", "left").join(queued, "recipe_id", "left")
    return joined.select(
        F.col("recipe_id").alias("id"), "name", "source", F.coalesce(F.col("owner") == ME, F.lit(False)).alias("is_mine"), "rating",
        F.coalesce("n", F.lit(0)).alias("cook_count"), "last_cooked", F.coalesce("queued", F.lit(False)).alias("is_queued"),
    )


@query(
    with_views("cook_log")
    + """SELECT recipe_id, user_id, count(*) AS cook_count, max(cooked_on) AS last_cooked, arg_max(source, (cooked_on, id)) = 'import' AS provisional
FROM cook_log GROUP BY recipe_id, user_id"""
)
def a3_recipe_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A3, Q2: cooks of each recipe and user, and the source of the latest by date, then id."""
    last = F.max(F.struct("cooked_on", "id", "source"))
    return view(spark, d, "cook_log").groupBy("recipe_id", "user_id").agg(F.count("*").alias("cook_count"), F.max("cooked_on").alias("last_cooked"), (last["source"] == "import").alias("provisional"))


@query(with_views("rating_log") + f", {_RATINGS} SELECT recipe_id, user_id, rating, rated_on FROM ratings")
def d1_rating_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Last write wins, ratings outside 1 to 5 are refused."""
    return ratings(spark, d).select("recipe_id", "user_id", "rating", "rated_on")


@query(with_views("queue_log") + f", {_QUEUE} SELECT user_id, recipe_id, added_at FROM recipe_queue")
def d2_queue_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The first of repeated additions stays."""
    return queue(spark, d).select("user_id", "recipe_id", "added_at")


@query(
    with_views("recipes", "cook_log")
    + "SELECT c.id, c.recipe_id, r.name, c.cooked_on, c.user_id FROM cook_log c JOIN recipes r ON r.id = c.recipe_id"
)
def q6_cooks(spark: SparkSession, d: str) -> DataFrame:
    """Cooks with their recipes, newest first."""
    recipes = view(spark, d, "recipes").select(F.col("id").alias("recipe_id"), "name")
    return view(spark, d, "cook_log").join(recipes, "recipe_id").select("id", "recipe_id", "name", "cooked_on", "user_id").orderBy(F.desc("cooked_on"), F.desc("id"))


@query(
    with_views("recipes", "queue_log")
    + f""", {_QUEUE}
SELECT q.recipe_id, r.name, r.category, q.added_at FROM recipe_queue q JOIN recipes r ON r.id = q.recipe_id WHERE q.user_id = {ME}"""
)
def q7_queue(spark: SparkSession, d: str) -> DataFrame:
    """One user's queue, newest first."""
    recipes = view(spark, d, "recipes").select(F.col("id").alias("recipe_id"), "name", "category")
    mine = queue(spark, d).where(F.col("user_id") == ME)
    return mine.join(recipes, "recipe_id").select("recipe_id", "name", "category", "added_at").orderBy(F.desc("added_at"), F.desc("recipe_id"))


@query(with_views("ingredients") + "SELECT id, name FROM ingredients")
def q3_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """The library by name, in binary order."""
    return by_name(view(spark, d, "ingredients").select("id", "name"), "name", "id")


_MIXED = "CASE id % 4 WHEN 0 THEN upper(name) WHEN 1 THEN concat('é', name) WHEN 2 THEN concat(upper(substring(name, 1, 1)), substring(name, 2)) ELSE name END"


@query(
    with_views("ingredients")
    + f""", mixed AS (SELECT id, kind, {_MIXED} AS name FROM ingredients)
SELECT id, name, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS in_bytes, row_number() OVER (PARTITION BY kind ORDER BY name COLLATE NOCASE, id) AS without_case,
  row_number() OVER (PARTITION BY kind ORDER BY name COLLATE en, id) AS as_read FROM mixed"""
)
def o1_collations(spark: SparkSession, d: str) -> DataFrame:
    """O1: places of an ingredient among its kind in binary order, without regard to case, and in the order of languages."""
    mixed = view(spark, d, "ingredients").selectExpr("id", "kind", f"{_MIXED} AS name")
    place = lambda collation: F.row_number().over(Window.partitionBy("kind").orderBy(F.collate(F.col("name"), collation), "id")).cast("bigint")
    return mixed.select("id", "name", place("UTF8_BINARY").alias("in_bytes"), place("UTF8_LCASE").alias("without_case"), place("UNICODE").alias("as_read"))


@query(
    with_views("ingredients", "lines")
    + """, seasons AS (SELECT DISTINCT ingredient_id, month FROM lines WHERE ingredient_id IS NOT NULL)
SELECT i.id, i.name, s.month::BIGINT AS month FROM seasons s JOIN ingredients i ON i.id = s.ingredient_id WHERE s.month = 7"""
)
def q5_in_season(spark: SparkSession, d: str) -> DataFrame:
    """What is in season in a given month."""
    seasons = view(spark, d, "lines").where("ingredient_id IS NOT NULL AND month = 7").select(F.col("ingredient_id").alias("id"), F.col("month").cast("bigint").alias("month")).distinct()
    return view(spark, d, "ingredients").select("id", "name").join(seasons, "id").orderBy("name", "id")


def regions_of(spark: SparkSession, d: str) -> DataFrame:
    """(ingredient_id, region, position): the bridge from ingredients to regions."""
    spot = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    nation = spot("nation").select("n_nationkey", "n_regionkey").join(F.broadcast(spot("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = spot("supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), F.col("r_name").alias("region"))
    return view(spark, d, "lines").where("ingredient_id IS NOT NULL").select("ingredient_id", "supplier", "position").join(supplier, "supplier").groupBy("ingredient_id", "region").agg(F.min("position").cast("bigint").alias("position"))


@query(
    with_views("ingredients", "lines")
    + """, bridge AS (
  SELECT ingredient_id, r_name AS region, min(position)::BIGINT AS position FROM lines JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE ingredient_id IS NOT NULL GROUP BY 1, 2)
SELECT id, name, (SELECT string_agg(m::VARCHAR, ',' ORDER BY m) FROM (SELECT DISTINCT month AS m FROM lines WHERE ingredient_id = i.id)) AS months,
  (SELECT string_agg(region, ',' ORDER BY position, region) FROM bridge WHERE ingredient_id = i.id) AS regions,
  (SELECT count(DISTINCT recipe_id) FROM lines WHERE ingredient_id = i.id) AS used_in
FROM ingredients i"""
)
def q4_ingredient_details(spark: SparkSession, d: str) -> DataFrame:
    """Every ingredient with its months, its regions in order and how many recipes use it."""
    lines = view(spark, d, "lines").where("ingredient_id IS NOT NULL").select("ingredient_id", "month", "recipe_id")
    months = lines.groupBy("ingredient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("month")), lambda m: m.cast("string")), ",").alias("months"), F.count_distinct("recipe_id").alias("used_in"))
    places = regions_of(spark, d).groupBy("ingredient_id").agg(F.array_sort(F.collect_list(F.struct("position", "region"))).alias("r"))
    places = places.select("ingredient_id", F.array_join(F.col("r.region"), ",").alias("regions"))
    out = view(spark, d, "ingredients").select("id", "name").join(months, F.col("id") == F.col("ingredient_id"), "left").drop("ingredient_id")
    return out.join(places, F.col("id") == F.col("ingredient_id"), "left").select("id", "name", "months", "regions", F.coalesce("used_in", F.lit(0)).alias("used_in"))


@query(with_views("recipes", "lines") + "SELECT id, name FROM recipes WHERE id IN (SELECT recipe_id FROM lines WHERE ingredient_id = 17)")
def j5_used_in(spark: SparkSession, d: str) -> DataFrame:
    """The recipes that use an ingredient, as a semi join."""
    used = view(spark, d, "lines").where("ingredient_id = 17").select(F.col("recipe_id").alias("id"))
    return view(spark, d, "recipes").select("id", "name").join(used, "id", "left_semi")


@query(
    with_views("photos", "cook_log")
    + """SELECT p.id, p.recipe_id, p.path, c.cooked_on, p.position::BIGINT AS position,
  row_number() OVER (PARTITION BY p.recipe_id ORDER BY p.position IS NULL, p.position, p.id)::BIGINT AS place,
  p.path = first_value(p.path) OVER (PARTITION BY p.recipe_id ORDER BY p.position IS NULL, p.position, p.id) AS is_hero
FROM photos p LEFT JOIN cook_log c ON c.id = p.cook_log_id"""
)
def j6_album(spark: SparkSession, d: str) -> DataFrame:
    """Photos in album order, unplaced ones last; those of no cook keep a null date."""
    cooks = view(spark, d, "cook_log").select(F.col("id").alias("cook_log_id"), "cooked_on")
    order = Window.partitionBy("recipe_id").orderBy(F.asc_nulls_last("position"), "id")
    return view(spark, d, "photos").join(cooks, "cook_log_id", "left").select(
        "id", "recipe_id", "path", "cooked_on", F.col("position").cast("bigint").alias("position"), F.row_number().over(order).cast("bigint").alias("place"), (F.col("path") == F.first("path").over(order)).alias("is_hero")
    )


@query(
    with_views("friend_log", "users")
    + f""", {_FRIENDSHIPS}
SELECT CASE WHEN requester = {ME} THEN addressee ELSE requester END AS friend, u.display_name, CASE WHEN status = 'accepted' THEN 'accepted' WHEN requester = {ME} THEN 'outgoing' ELSE 'incoming' END AS bucket
FROM friendships JOIN users u ON u.id = CASE WHEN requester = {ME} THEN addressee ELSE requester END WHERE requester = {ME} OR addressee = {ME}"""
)
def q8_friends(spark: SparkSession, d: str) -> DataFrame:
    """One user's friends and requests, in buckets."""
    me = friendships(spark, d).where((F.col("requester") == ME) | (F.col("addressee") == ME))
    me = me.withColumns({"friend": F.when(F.col("requester") == ME, F.col("addressee")).otherwise(F.col("requester")), "bucket": F.when(F.col("status") == "accepted", "accepted").when(F.col("requester") == ME, "outgoing").otherwise("incoming")})
    users = view(spark, d, "users").select(F.col("id").alias("friend"), "display_name")
    return me.join(users, "friend").select("friend", "display_name", "bucket")


@query(with_views("friend_log") + f", {_FRIENDSHIPS} SELECT requester, addressee, created_at, status FROM friendships")
def d11_friend_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each pair after all requests; a request in return accepts."""
    return friendships(spark, d).select("requester", "addressee", "created_at", "status")


@query(
    with_views("friend_log")
    + f""", {_FRIENDSHIPS}
SELECT a AS user_id, count(*) AS friends FROM (SELECT requester AS a, addressee AS b FROM friendships WHERE status = 'accepted' UNION SELECT addressee, requester FROM friendships WHERE status = 'accepted') GROUP BY a"""
)
def j13_friend_counts(spark: SparkSession, d: str) -> DataFrame:
    """The undirected graph from one stored direction."""
    both = symmetric(friendships(spark, d).where("status = 'accepted'").select("requester", "addressee"), "requester", "addressee")
    return both.groupBy(F.col("a").alias("user_id")).agg(F.count("*").alias("friends"))


_FEED = (
    with_views("friend_log", "posts", "cook_log", "recipes", "users", "comments")
    + f""", {_FRIENDSHIPS},
near AS (SELECT requester AS a, addressee AS b FROM friendships WHERE status = 'accepted' UNION SELECT addressee, requester FROM friendships WHERE status = 'accepted' UNION SELECT id, id FROM users)"""
)


@query(
    _FEED
    + f""", talk AS (SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR || ':' || body, '|' ORDER BY turn, body) AS thread FROM comments GROUP BY conv_id),
numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM posts)
SELECT p.id, p.user_id, u.display_name, CASE WHEN p.cook_log_id IS NOT NULL THEN 'cook' ELSE 'recipe' END AS post_type, coalesce(c.recipe_id, p.recipe_id) AS recipe_id, r.name AS recipe_name, c.cooked_on,
  nullif(trim(p.caption), '') AS caption, p.created_at
FROM posts p JOIN near ON near.b = p.user_id AND near.a = {ME} JOIN users u ON u.id = p.user_id LEFT JOIN cook_log c ON c.id = p.cook_log_id LEFT JOIN recipes r ON r.id = coalesce(c.recipe_id, p.recipe_id)
WHERE p.created_at >= '{CUTOFF}' AND p.created_at <= '{NOW}' ORDER BY p.created_at DESC, p.id DESC LIMIT {FEED_ROWS}"""
)
def q9_feed(spark: SparkSession, d: str) -> DataFrame:
    """One user's feed, fourteen days and fifty posts, resolved by joins."""
    near = symmetric(friendships(spark, d).where("status = 'accepted'").select("requester", "addressee"), "requester", "addressee").where(F.col("a") == ME).select(F.col("b").alias("user_id"))
    near = near.union(spark.range(1).select(F.lit(ME).cast("bigint").alias("user_id"))).distinct()
    posts = view(spark, d, "posts").where((F.col("created_at") >= CUTOFF) & (F.col("created_at") <= NOW)).where("isnotnull(cook_log_id) <> isnotnull(recipe_id)")
    top = posts.join(near, "user_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(FEED_ROWS)
    cooks = view(spark, d, "cook_log").select(F.col("id").alias("cook_log_id"), F.col("recipe_id").alias("cooked"), "cooked_on")
    users = view(spark, d, "users").select(F.col("id").alias("user_id"), "display_name")
    recipes = view(spark, d, "recipes").select(F.col("id").alias("recipe_id"), F.col("name").alias("recipe_name"))
    out = top.join(cooks, "cook_log_id", "left").withColumn("post_type", F.when(F.col("cook_log_id").isNotNull(), "cook").otherwise("recipe")).withColumn("recipe_id", F.coalesce("cooked", "recipe_id"))
    out = out.join(users, "user_id").join(recipes, "recipe_id", "left").withColumn("caption", F.nullif(F.trim("caption"), F.lit("")))
    return out.select("id", "user_id", "display_name", "post_type", "recipe_id", "recipe_name", "cooked_on", "caption", "created_at")


@query(
    _FEED
    + f""", seen AS (
  SELECT near.a AS viewer, p.id, p.created_at, row_number() OVER (PARTITION BY near.a ORDER BY p.created_at DESC, p.id DESC) AS n
  FROM posts p JOIN near ON near.b = p.user_id WHERE p.created_at >= '{CUTOFF}')
SELECT viewer, count(*) AS posts, min(created_at) AS oldest, max(created_at) AS newest FROM seen WHERE n <= {FEED_ROWS} GROUP BY viewer"""
)
def w6_feeds_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty posts of every user's feed, summed up."""
    near = symmetric(friendships(spark, d).where("status = 'accepted'").select("requester", "addressee"), "requester", "addressee")
    near = near.union(view(spark, d, "users").select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    posts = view(spark, d, "posts").where(F.col("created_at") >= CUTOFF).select(F.col("user_id").alias("b"), "id", "created_at")
    seen = newest(near.join(posts, "b"), ["a"], [F.desc("created_at"), F.desc("id")], FEED_ROWS)
    return seen.groupBy(F.col("a").alias("viewer")).agg(F.count("*").alias("posts"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


@query(
    with_views("posts", "turns")
    + """, numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM posts)
SELECT n.id AS post_id, count(*) AS comments, string_agg(c.turn::VARCHAR || ':' || c.body, '|' ORDER BY c.turn, c.body) AS thread
FROM numbered n JOIN turns c ON c.conv_id = n.ordinal GROUP BY n.id"""
)
def a16_all_threads(spark: SparkSession, d: str) -> DataFrame:
    """Each post's comments nested, oldest first, with their whole text."""
    return threads(view(spark, d, "posts"), view(spark, d, "turns"))


def numbered(rows: DataFrame, width: int = 10_000) -> DataFrame:
    """(id, ordinal): rows by id from 0 on, numbered within ranges of ``width`` ids, each from the count of those before it.

    Only the counts of ranges pass through one task.
    """
    ranged = rows.select("id", F.floor(F.col("id") / width).alias("range"))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("id")))
    return placed.join(counts.select("range", F.coalesce(before, F.lit(0)).alias("before")), "range").select("id", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("ordinal"))


def threads(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(post_id, comments, thread). Threads are numbered like the posts of their ordinal."""
    talk = comments.groupBy("conv_id").agg(F.count("*").alias("comments"), F.array_sort(F.collect_list(F.struct("turn", "body"))).alias("t"))
    talk = talk.select("conv_id", "comments", F.array_join(F.transform("t", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["body"])), "|").alias("thread"))
    return numbered(posts).withColumnRenamed("ordinal", "conv_id").join(talk, "conv_id").select(F.col("id").alias("post_id"), "comments", "thread")


@query(
    with_views("lines")
    + """, before AS (SELECT DISTINCT ingredient_id, month FROM lines WHERE ingredient_id IS NOT NULL AND supplier % 3 <> 0), later AS (SELECT DISTINCT ingredient_id, month FROM lines WHERE ingredient_id IS NOT NULL AND supplier % 3 <> 1)
SELECT *, 'gone' AS change FROM (FROM before EXCEPT FROM later) UNION ALL SELECT *, 'new' FROM (FROM later EXCEPT FROM before)"""
)
def d4_rebuilt_seasons(spark: SparkSession, d: str) -> DataFrame:
    """What a rebuild of the seasons from a changed library takes away and brings."""
    lines = view(spark, d, "lines").where("ingredient_id IS NOT NULL")
    seasons = lambda where: lines.where(where).select("ingredient_id", "month").distinct()
    return rebuild_changes(seasons("supplier % 3 <> 0"), seasons("supplier % 3 <> 1"))


@query(with_views("users") + "SELECT id, lower(trim(email)) AS email, is_admin FROM users WHERE lower(trim(email)) = lower(trim(' CUSTOMER#000000007@example.org'))")
def j20_user_by_email(spark: SparkSession, d: str) -> DataFrame:
    """A user by normalized address."""
    key = F.lower(F.trim("email"))
    return view(spark, d, "users").where(key == F.lower(F.trim(F.lit(" CUSTOMER#000000007@example.org")))).where(key.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).select("id", key.alias("email"), "is_admin")


@query(
    with_views("users")
    + """SELECT id, 'code-' || (id * 31 % 1009)::VARCHAR AS code, id % 3 = 0 AS used, CASE WHEN id % 3 = 0 THEN 'used' WHEN id % 4 = 1 AND '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') || ' 00:00:00' < '2024-01-15 00:00:00' THEN 'expired' ELSE 'valid' END AS state
FROM users WHERE id % 5 = 2"""
)
def q10_invites(spark: SparkSession, d: str) -> DataFrame:
    """One creator's invites, newest first, and whether they can still be used (text comparison of times)."""
    ends = F.when(F.col("id") % 4 == 1, F.date_format(F.try_to_timestamp(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))), "yyyy-MM-dd HH:mm:ss"))
    mine = view(spark, d, "users").where("id % 5 = 2").withColumn("ends", ends)
    state = F.when(F.col("id") % 3 == 0, "used").when(F.col("ends") < "2024-01-15 00:00:00", "expired").otherwise("valid")
    return mine.orderBy(F.desc("id")).select("id", F.concat(F.lit("code-"), (F.col("id") * 31 % 1009).cast("string")).alias("code"), (F.col("id") % 3 == 0).alias("used"), state.alias("state"))


@query(with_views("recipes") + "SELECT id, name, source FROM recipes WHERE (owner IS NULL OR owner = 7) AND source <> 'test' AND created_at >= '1996-01-01 00:00:00'")
def p_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters on equality, either-or, null and ranges of text times, pushed to the scan where they can be."""
    r = view(spark, d, "recipes").where(F.col("owner").isNull() | (F.col("owner") == 7)).where("source <> 'test'").where(F.col("created_at") >= "1996-01-01 00:00:00")
    return r.select("id", "name", "source").orderBy(F.col("source") == "test", "name")


@query(
    with_views("recipes", "cook_log")
    + f"""SELECT r.id, coalesce(r.owner = {ME}, false) AND NOT EXISTS (SELECT 1 FROM cook_log c WHERE c.recipe_id = r.id AND c.user_id = {ME}) AS to_make FROM recipes r WHERE r.owner = {ME}"""
)
def p13_to_make(spark: SparkSession, d: str) -> DataFrame:
    """Owned and never cooked."""
    cooked = view(spark, d, "cook_log").where(F.col("user_id") == ME).select(F.col("recipe_id").alias("id"), F.lit(True).alias("cooked")).distinct()
    return view(spark, d, "recipes").where(F.col("owner") == ME).join(cooked, "id", "left").select("id", F.col("cooked").isNull().alias("to_make"))


@query(with_views("lines") + "SELECT recipe_id, position, coalesce(nullif(label, ''), raw_text) AS shown, tiebreak FROM lines WHERE ingredient_id IS NULL AND coalesce(label, '') = ''")
def p16_first_filled(spark: SparkSession, d: str) -> DataFrame:
    """The first text that isn't empty; empty and null are the same."""
    from larder.operators.rows import blank, first_filled

    return view(spark, d, "lines").where("ingredient_id IS NULL").where(blank("label")).select("recipe_id", "position", first_filled("label", "raw_text").alias("shown"), "tiebreak")


@query(with_views("recipes") + "SELECT id FROM recipes WHERE category LIKE '%URGENT%' AND list_contains(list_transform(string_split(category, '-'), lambda t: trim(t)), 'URGENT')")
def p7_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """A coarse LIKE, then the exact tag."""
    tags = F.transform(F.split("category", "-"), lambda t: F.trim(t))
    return view(spark, d, "recipes").where(F.col("category").like("%URGENT%")).where(F.array_contains(tags, "URGENT")).select("id")
