"""Sources: the weight chart, recipe archives, and the kinds of images by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

CHART = "category string, ingredient string, grams double, reference_volume string"


def weight_chart(spark: SparkSession, path: str) -> DataFrame:
    """The chart's rows in their order; lines that begin with # are comments."""
    rows = spark.read.schema(CHART).option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("ordinal", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def archive(spark: SparkSession, path: str, members: int = 256) -> DataFrame:
    """(archive, entry, record, error) of each member of zipped archives: its JSON text, or why it can't be read.

    ``path`` may have wildcards. Archives are read in ranges of ``members`` of their lists of contents, each by a
    task of its own, so a large one is never held whole. What can't be opened is one row with its error.
    """
    from larder.sources.archives import RecipeArchive

    spark.dataSource.register(RecipeArchive)
    return spark.read.format(RecipeArchive.name()).option("members", members).load(path)


def image_kind(encoded: Column) -> Column:
    """JPEG, PNG, GIF, WEBP or HEIC by the first bytes of a base64 text; null for others."""
    head = F.hex(F.substring(F.try_to_binary(F.substring(encoded, 1, 32), F.lit("base64")), 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^.{8}66747970(68656963|68656978|6D696631|68657663)"), "heic")


def image_type(encoded: Column) -> Column:
    """The kind of an image in base64 as the archive reader names it, ``unknown`` with its first four bytes, or why it can't be decoded."""
    raw = F.try_to_binary(encoded, F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 12))
    named = (
        F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.rlike("^47494638(37|39)61"), "GIF").when(head.rlike("^52494646.{8}57454250"), "WEBP")
        .when(head.rlike("^.{8}66747970(68656963|68656978|6D696631|6D736631)"), "HEIC/HEIF").otherwise(F.concat(F.lit("unknown("), F.lower(F.substring(head, 1, 8)), F.lit(")")))
    )
    return F.when(raw.isNull() & encoded.isNotNull(), "DECODE-ERROR").otherwise(named)


_TEXTS = ("source", "source_url", "notes", "description", "uid", "hash", "prep_time", "cook_time", "total_time", "difficulty", "nutritional_info")
RECORD = f"name string, ingredients string, directions string, servings string, categories array<string>, rating int, photo string, photo_large string, photo_data string, photos array<struct<filename:string,hash:string,name:string,data:string>>, {', '.join(f'{t} string' for t in _TEXTS)}"


def normalized(records: DataFrame) -> DataFrame:
    """Records (entry, record) of an archive in the one shape of imports; what is missing is an empty text or list.

    Images are measured, not stored. Records that are no JSON give nulls for all fields.
    """
    from larder.functions import text

    r = records.select("entry", F.from_json("record", RECORD).alias("r")).where("r IS NOT NULL")
    said = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    size = lambda data: F.length(F.try_to_binary(F.coalesce(data, F.lit("")), F.lit("base64")))
    image = lambda p: F.struct(p["filename"].alias("filename"), p["hash"].alias("hash"), p["name"].alias("name"), F.length(F.coalesce(p["data"], F.lit(""))).alias("b64_len"), size(p["data"]).alias("bytes"), image_type(F.coalesce(p["data"], F.lit(""))).alias("type"))
    lines = lambda c: F.filter(F.transform(F.split(said(c), "\n"), text.strip), lambda x: x != "")
    data = F.col("r.photo_data")
    photo = F.when(F.coalesce(data, F.lit("")) != "", F.struct(size(data).alias("bytes"), image_type(data).alias("type"), F.length(data).alias("b64_len")))
    return r.select(
        "entry", text.unquoted(F.col("r.name")).alias("name"), said("name").alias("name_raw"), lines("ingredients").alias("ingredient_lines"),
        F.when(said("ingredients") == "", 0).otherwise(F.size(F.split(said("ingredients"), "\n")) - F.size(lines("ingredients"))).alias("blank_breaks"), lines("directions").alias("directions"),
        said("servings").alias("servings_raw"), F.coalesce("r.categories", F.array().cast("array<string>")).alias("categories"), *(said(t).alias(t) for t in _TEXTS), F.col("r.rating").alias("rating"),
        F.transform(F.coalesce("r.photos", F.array().cast("array<struct<filename:string,hash:string,name:string,data:string>>")), image).alias("images"), photo.alias("primary_photo"), said("photo").alias("photo_ref"), said("photo_large").alias("photo_large_ref"),
    )
