"""Sources and streams."""

import base64
import gzip
import json
import zipfile

from pyspark.sql import functions as F

from larder.functions.weights import density_chart
from larder.sources.files import archive, image_kind, weight_chart
from larder.streaming.feed import cooks_by_hour, first_additions


def test_weight_chart(spark, tmp_path):
    (tmp_path / "chart.csv").write_text("# a comment\n# another\ncategory,ingredient,grams,reference_volume\nFlour,All-Purpose Flour,120,1 cup\nFlour,,5,1 cup\nSweet,Honey,21,1 tablespoon\nOdd,Thing,9,1 stick\nOdd,None,,1 cup\n")
    rows = density_chart(weight_chart(spark, str(tmp_path / "chart.csv"))).orderBy("ordinal").collect()
    assert [(r.lookup_key, round(r.grams_per_ml, 4)) for r in rows] == [("all purpose flour", round(120 / 236.588, 4)), ("honey", round(21 / 14.7868, 4))]


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.paprikarecipe", gzip.compress(json.dumps({"name": "Pie"}).encode()))
        z.writestr("bad.paprikarecipe", b"not gzip")
        z.writestr("worse.paprikarecipe", gzip.compress(b"{not json"))
        z.writestr("readme.txt", b"x")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {r.entry: r for r in archive(spark, str(tmp_path / "*.zip")).collect()}
    assert json.loads(got["good.paprikarecipe"].record) == {"name": "Pie"} and got["good.paprikarecipe"].error is None
    assert all(got[k].record is None and got[k].error for k in ("bad.paprikarecipe", "worse.paprikarecipe", None))
    assert len(got) == 4


def test_image_kinds(spark):
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF89a", "webp": b"RIFF\0\0\0\0WEBP", "heic": b"\0\0\0\x18ftypheic", None: b"plain text"}
    df = spark.createDataFrame([(k, base64.b64encode(v + b"\0" * 20).decode()) for k, v in heads.items()], "k string, b string")
    assert all(r.k == r.got for r in df.select("k", image_kind(F.col("b")).alias("got")).collect())


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, build, mode, batch in (
        ("first", lambda s: first_additions(s, "60 days"), "append", events.where("event_type = 'click'").select("user_id", (F.col("event_id") * 7 % 400).alias("r")).distinct().count()),
        ("hours", lambda s: cooks_by_hour(s, "60 days"), "complete", events.where("event_type = 'purchase'").select(F.date_trunc("hour", "ts")).distinct().count()),
    ):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        assert spark.table(name).count() == batch
