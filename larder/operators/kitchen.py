"""Writes of the kitchen as batches: photos, cooks, created recipes, seed rows, snapshots and what reads show of them.

A batch of requests is judged with joins, every request for itself, and gives one row for each with
its outcome; what several requests of one recipe share (album places, the first image) is settled by
the order of their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.functions import amounts, text
from larder.operators.slugs import numbered

#: The longest caption of a photo.
PHOTO_CAPTION_MAX = 60
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def attach_photos(requests: DataFrame, recipes: DataFrame, cooks: DataFrame, photos: DataFrame) -> DataFrame:
    """Outcome of each request (id, recipe_id, user_id, cook_log_id, path, caption): refusal, caption, position, is_hero.

    A photo goes to one's own cook of the recipe, or without a cook to one's own recipe, at the end of
    the album. The first one becomes the image of a recipe without an image, if its owner sent it.
    """
    said = text.caption(F.col("caption"))
    r = recipes.select(F.col("id").alias("recipe_id"), "owner", "image", F.lit(True).alias("there"))
    c = cooks.select(F.col("id").alias("cook_log_id"), F.col("recipe_id").alias("cooked"), F.col("user_id").alias("cook"))
    judged = requests.withColumn("caption", said).join(r, "recipe_id", "left").join(c, "cook_log_id", "left")
    refusal = (
        F.when(F.length("caption") > PHOTO_CAPTION_MAX, "caption too long")
        .when(F.col("there").isNull(), "recipe not found")
        .when(F.col("cook_log_id").isNotNull() & ~F.coalesce(F.col("cooked") == F.col("recipe_id"), F.lit(False)), "cook not found for this recipe")
        .when(F.col("cook_log_id").isNotNull() & ~F.coalesce(F.col("cook") == F.col("user_id"), F.lit(False)), "not your cook")
        .when(F.col("cook_log_id").isNull() & ~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)), "not your recipe")
    )
    judged = judged.withColumn("refusal", refusal)
    top = photos.groupBy("recipe_id").agg(F.max("position").alias("top"))
    good = numbered(judged.where("refusal IS NULL"), ["recipe_id"], "id").join(top, "recipe_id", "left")
    good = good.withColumn("position", (F.coalesce("top", F.lit(-1)) + F.col("nth")).cast("long"))
    own = F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)) & (F.coalesce("image", F.lit("")) == "")
    first = judged.where("refusal IS NULL").where(own).groupBy("recipe_id").agg(F.min("id").alias("hero"))
    good = good.join(first, "recipe_id", "left").withColumn("is_hero", F.coalesce(F.col("hero") == F.col("id"), F.lit(False)))
    none = judged.where("refusal IS NOT NULL").select("id", "recipe_id", "refusal", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("long").alias("position"), F.lit(False).alias("is_hero"))
    return good.select("id", "recipe_id", "refusal", "caption", "position", "is_hero").unionByName(none)


def delete_photos(requests: DataFrame, photos: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(photos left, recipes with cleared images, paths that nothing names any more) after requests (photo_id, user_id)."""
    gone = photos.join(requests.select(F.col("photo_id").alias("id"), "user_id").distinct(), ["id", "user_id"], "left_semi")
    left = photos.join(gone.select("id"), "id", "left_anti")
    was = gone.select(F.col("recipe_id").alias("id"), F.col("path").alias("image"), F.lit(True).alias("cleared")).distinct()
    cleared = recipes.join(was, ["id", "image"], "left").withColumn("image", F.when(F.col("cleared").isNull(), F.col("image"))).drop("cleared").select(*recipes.columns)
    named = left.select("path").unionByName(cleared.where("image IS NOT NULL").select(F.col("image").alias("path")))
    return left, cleared, gone.select("path").distinct().join(named, "path", "left_anti")


def insert_cooks(requests: DataFrame, recipes: DataFrame, today: str) -> DataFrame:
    """(id, recipe_id, user_id, cooked_on, refusal) of requests (id, recipe_id, user_id, date): a real date, not in the future; none means today."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col("date"), "yyyy-MM-dd"))
    known = requests.join(recipes.select(F.col("id").alias("recipe_id"), F.lit(True).alias("there")), "recipe_id", "left")
    refusal = F.when(F.col("date").isNotNull() & day.isNull(), "not a date").when(day > F.lit(today).cast("date"), "in the future").when(F.col("there").isNull(), "recipe not found")
    return known.select("id", "recipe_id", "user_id", F.when(refusal.isNull(), F.coalesce("date", F.lit(today))).alias("cooked_on"), refusal.alias("refusal"))


def broken_links(lines: DataFrame, library: DataFrame) -> DataFrame:
    """(recipe_id, key, place) of linked items and of links in steps that the library doesn't have.

    ``lines`` has recipe_id, item (null for steps) and text. Of a text all links count.
    """
    items = lines.where("coalesce(item, '') <> ''").select("recipe_id", F.col("item").alias("key"), F.lit("line").alias("place"))
    keys = F.transform(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)), lambda k: text.strip(k))
    steps = lines.where("item IS NULL").select("recipe_id", F.explode(keys).alias("key"), F.lit("step").alias("place"))
    return items.unionByName(steps).join(library.select(F.col("id").alias("key")), "key", "left_anti").select("recipe_id", "key", "place")


def create_recipes(requests: DataFrame, recipes: DataFrame, broken: DataFrame) -> DataFrame:
    """(id, slug, source, refusal) of requests (id, name, is_test, recipe_id): valid links, a name that makes a slug, and a free one.

    Of requests for one slug the first that is valid gets it.
    """
    bad = broken.select("recipe_id", F.lit(True).alias("bad")).distinct()
    rows = requests.withColumn("slug", text.slug(F.col("name"))).join(bad, "recipe_id", "left")
    rows = rows.join(recipes.select(F.col("id").alias("slug"), F.lit(True).alias("taken")).distinct(), "slug", "left")
    early = F.when(F.col("bad"), "broken link").when(F.coalesce("slug", F.lit("")) == "", "no slug").when(F.col("taken"), "slug taken")
    rows = rows.withColumn("early", early)
    first = rows.where("early IS NULL").groupBy("slug").agg(F.min("id").alias("first"))
    rows = rows.join(first, "slug", "left")
    refusal = F.coalesce("early", F.when(F.col("first") != F.col("id"), "slug taken"))
    return rows.select("id", F.when(refusal.isNull(), F.col("slug")).alias("slug"), F.when(F.col("is_test"), "test").otherwise("app").alias("source"), refusal.alias("refusal"))


def with_parts(rows: DataFrame, qty: Column) -> DataFrame:
    """``rows`` with ``_quantity`` and ``_unit``, the parts of ``qty``; each different text is split once, a null one as an empty one."""
    rows = rows.withColumn("_qty", F.coalesce(qty, F.lit("")))
    # both parts from one reading
    read = rows.select("_qty").distinct().select("_qty", F.explode(F.array(amounts.split_quantity(F.col("_qty")))).alias("_p"))
    return rows.join(read.select("_qty", F.col("_p.quantity").alias("_quantity"), F.col("_p.unit").alias("_unit")), "_qty", "left").drop("_qty")


def seed_rows(recipes: DataFrame) -> DataFrame:
    """Line rows of seed recipes (recipe_id, ingredients array<struct<heading,item,qty,label,note,text>>).

    A heading is text alone, a linked item keeps its parts and writes its text from them, other lines
    are text with an amount.
    """
    rows = with_parts(recipes.select("recipe_id", F.posexplode("ingredients").alias("position", "r")), F.col("r.qty"))
    heading, item = F.col("r.heading").isNotNull(), F.col("r.heading").isNull() & F.col("r.item").isNotNull()
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    written = text.strip(F.concat(null("r.qty"), F.lit(" "), null("r.label"), null("r.note")))
    return rows.select(
        "recipe_id", "position", heading.cast("int").alias("is_heading"), F.when(~heading, F.col("r.qty")).alias("qty"),
        F.when(~heading, F.col("_quantity")).alias("quantity"), F.when(~heading, F.col("_unit")).alias("unit"), F.when(item, F.col("r.item")).alias("ingredient_id"),
        F.when(item, F.col("r.label")).alias("label"), F.when(item, F.col("r.note")).alias("note"),
        F.when(heading, F.col("r.heading")).when(item, written).otherwise(null("r.text")).alias("raw_text"),
    )


def backfill_parts(lines: DataFrame) -> DataFrame:
    """``lines`` (qty, quantity, unit, is_heading, ...) with the parts of those that have no quantity; headings stay as they are."""
    missing = F.col("quantity").isNull() & (F.col("is_heading") == 0)
    rows = with_parts(lines, F.when(missing, F.col("qty")))
    told = {"quantity": F.when(missing, F.col("_quantity")).otherwise(F.col("quantity")), "unit": F.when(missing, F.col("_unit")).otherwise(F.col("unit"))}
    return rows.select(*(told.get(c, F.col(c)).alias(c) for c in lines.columns))


def capture_snapshots(contents: DataFrame, cooks: DataFrame, snapshots: DataFrame, born: DataFrame) -> DataFrame:
    """C11: snapshots to add (recipe_id, reason, cook_log_id, user_id, content): one for each cook, and the original of born recipes once.

    ``contents`` (recipe_id, content), ``cooks`` (id, recipe_id, user_id), ``born`` (recipe_id, user_id).
    """
    cooked = cooks.select(F.col("id").alias("cook_log_id"), "recipe_id", "user_id").join(contents, "recipe_id").select("recipe_id", F.lit("cook").alias("reason"), "cook_log_id", "user_id", "content")
    have = snapshots.where("reason = 'original'").select("recipe_id")
    first = born.groupBy("recipe_id").agg(F.min("user_id").alias("user_id")).join(have, "recipe_id", "left_anti").join(contents, "recipe_id")
    return cooked.unionByName(first.select("recipe_id", F.lit("original").alias("reason"), F.lit(None).cast("long").alias("cook_log_id"), "user_id", "content"))


def annotation_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change entries by where they show: (recipe_id, kind, new_pos, added, amount, name, mod), and the removed ones in old order.

    Headings and what has no place on the page are left out.
    """
    rows = entries.where("kind IN ('ingredient', 'step')")
    change = F.concat_ws(" -> ", F.coalesce("from", F.lit("")), F.coalesce("to", F.lit("")))
    of = lambda when, what, name: F.max(F.when(when, what)).alias(name)
    modified = F.col("type") == "modified"
    placed = rows.where("type <> 'removed' AND new_pos IS NOT NULL").groupBy("recipe_id", "kind", "new_pos").agg(
        of(F.col("type") == "added", F.col("text"), "added"), of(modified & (F.col("field") == "amount"), change, "amount"), of(modified & (F.col("field") == "name"), change, "name"), of(modified & (F.col("kind") == "step"), change, "mod")
    )
    removed = rows.where("type = 'removed'").groupBy("recipe_id", "kind").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("old_pos", F.lit(0)).alias("old_pos"), "text", "section"))).alias("removed"))
    return placed, removed


def recipe_detail(recipes: DataFrame, lines: DataFrame, steps: DataFrame, stats: DataFrame, ratings: DataFrame, queued: DataFrame, photos: DataFrame, annotations: DataFrame, user: int) -> DataFrame:
    """Q2: one nested row for each recipe: flags, lines with densities, steps with spans, the user's statistics, album, and changes since its birth.

    Every part is one aggregate by recipe_id, sorted inside; a recipe without a part has an empty list.
    """
    nest = lambda rows, name, *columns: rows.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    album = photos.join(recipes.select(F.col("id").alias("recipe_id"), "image"), "recipe_id").select("recipe_id", F.col("position").isNull().alias("loose"), "position", "id", "path", "cooked_on", F.coalesce(F.col("image") == F.col("path"), F.lit(False)).alias("is_hero"))
    parts = [
        nest(lines, "ingredients", *(c for c in lines.columns if c != "recipe_id")),
        nest(steps, "steps", *(c for c in steps.columns if c != "recipe_id")),
        nest(album, "photos", "loose", "position", "id", "path", "cooked_on", "is_hero"),
        nest(annotations, "annotations", *(c for c in annotations.columns if c != "recipe_id")),
        stats.where(F.col("user_id") == user).drop("user_id"),
        ratings.where(F.col("user_id") == user).select("recipe_id", "rating"),
        queued.where(F.col("user_id") == user).select("recipe_id", F.lit(True).alias("is_queued")).distinct(),
    ]
    whole = reduce(lambda df, part: df.join(part, "recipe_id", "left"), parts, recipes.withColumnRenamed("id", "recipe_id"))
    empty: dict[str, Column] = {c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)) for c in ("ingredients", "steps", "photos", "annotations")}
    flags = {
        "is_editable": F.col("source").isin("app", "test"), "is_mine": F.coalesce(F.col("owner") == user, F.lit(False)), "is_seed": F.col("source") == "seed", "is_test": F.col("source") == "test",
        "is_queued": F.coalesce("is_queued", F.lit(False)), "cook_count": F.coalesce("cook_count", F.lit(0)),
    }
    return whole.withColumns({**empty, **flags}).withColumnRenamed("recipe_id", "id")


def varied_sample(rows: DataFrame, predicates: list[tuple[str, Column]], target: int = 9, seed: int = 42) -> DataFrame:
    """(id, reason): the first row (by id) of each predicate that no earlier one chose, then a seeded fill up to ``target`` rows."""
    firsts = rows.agg(*(F.min(F.when(p, F.col("id"))).alias(f"p{i}") for i, (_, p) in enumerate(predicates)))
    each = firsts.select(F.explode(F.array(*(F.struct(F.col(f"p{i}").alias("id"), F.lit(i).alias("at"), F.lit(name).alias("reason")) for i, (name, _) in enumerate(predicates)))).alias("c")).select("c.*").where("id IS NOT NULL")
    chosen = each.groupBy("id").agg(F.min(F.struct("at", "reason")).alias("c")).select("id", F.col("c.at").alias("at"), F.col("c.reason").alias("reason"))
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    # at most ``target`` rows are chosen or drawn, which is the feature
    fill = rows.select("id").join(chosen, "id", "left_anti").withColumn("draw", draw).orderBy("draw", "id").limit(target).select("id", (F.lit(len(predicates)) + F.row_number().over(Window.orderBy("draw", "id"))).alias("at"), F.lit("random").alias("reason"))
    return chosen.unionByName(fill).orderBy("at").limit(target).select("id", "reason")


def servings_base(servings: Column) -> Column:
    """the first whole number in a text; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(servings, F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("int")


def promote_photos(requests: DataFrame, photos: DataFrame, recipes: DataFrame) -> DataFrame:
    """``recipes`` with the images that their owners chose: of requests (id, photo_id, user_id) the last of a recipe counts."""
    asked = requests.join(photos.select(F.col("id").alias("photo_id"), "recipe_id", "path"), "photo_id")
    asked = asked.join(recipes.select(F.col("id").alias("recipe_id"), "owner"), "recipe_id").where("owner = user_id")
    last = asked.groupBy(F.col("recipe_id").alias("id")).agg(F.max_by("path", "id").alias("chosen"))
    return recipes.join(last, "id", "left").withColumn("image", F.coalesce("chosen", "image")).select(*recipes.columns)


def change_friends(pairs: DataFrame, accepted: DataFrame, removed: DataFrame) -> DataFrame:
    """``pairs`` (requester, addressee, status) after acceptances (user_id, friend) of requests made to the user, and removals by either side."""
    said = accepted.select(F.col("friend").alias("requester"), F.col("user_id").alias("addressee"), F.lit(True).alias("said")).distinct()
    ends = removed.select(F.least("user_id", "friend").alias("lo"), F.greatest("user_id", "friend").alias("hi")).distinct()
    now = pairs.join(said, ["requester", "addressee"], "left").withColumn("status", F.when(F.col("said"), "accepted").otherwise(F.col("status"))).drop("said")
    return now.withColumns({"lo": F.least("requester", "addressee"), "hi": F.greatest("requester", "addressee")}).join(ends, ["lo", "hi"], "left_anti").select(*pairs.columns)


def consume_invites(signups: DataFrame, invites: DataFrame) -> DataFrame:
    """(id, refusal) of signups (id, code, at): the code exists, is unused and not past its end (as text); of several signups the first valid one takes it."""
    known = signups.join(invites.select("code", "used", "expires_at", F.lit(True).alias("there")), "code", "left")
    early = F.when(F.col("there").isNull(), "no such invite").when(F.col("used"), "used").when(F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.col("at")), "expired")
    known = known.withColumn("early", early)
    first = known.where("early IS NULL").groupBy("code").agg(F.min(F.struct("at", "id"))["id"].alias("first"))
    return known.join(first, "code", "left").select("id", F.coalesce("early", F.when(F.col("first") != F.col("id"), "used")).alias("refusal"))


def null_dead_pointers(recipes: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """``recipes`` whose image is no file lose it, of the given ids alone."""
    dead = recipes.where("image IS NOT NULL").select("id", "image").join(ids, "id", "left_semi").join(files.select(F.col("path").alias("image")), "image", "left_anti").select("id", F.lit(True).alias("dead"))
    return recipes.join(dead, "id", "left").withColumn("image", F.when(F.col("dead").isNull(), F.col("image"))).select(*recipes.columns)


def resolve_owner(users: DataFrame, email: str | None = None) -> DataFrame:
    """(id) of the user with an address, or of the only user; anything else is an error when the row is read."""
    found = users.where(F.lower(F.trim("email")) == email.strip().lower()) if email else users
    one = found.agg(F.min("id").alias("id"), F.count("*").alias("n"))
    message = F.concat(F.lit("no single owner: "), F.col("n").cast("string"), F.lit(" users"))
    return one.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(message).cast("long")).alias("id"))


def cook_and_rate(requests: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cooks, ratings) of requests (id, recipe_id, user_id, on, rating, cooks): ratings from 1 to 5 of known recipes, the last one wins; a rating needs no cook."""
    known = requests.join(recipes.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi").where(F.col("rating").isNull() | F.col("rating").between(1, 5))
    cooks = known.where("cooks").select("id", "recipe_id", "user_id", F.col("on").alias("cooked_on"))
    rated = known.where("rating IS NOT NULL").groupBy("recipe_id", "user_id").agg(F.max_by(F.struct("rating", "on"), "id").alias("r"))
    return cooks, rated.select("recipe_id", "user_id", "r.rating", F.col("r.on").alias("rated_on"))
