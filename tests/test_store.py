"""The commit sink under several writers, archives read by members, and SQLite tables read in ranges."""

import gzip
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from larder.sources import database, staged
from larder.sources.files import archive

SCHEMA = "id long, name string"


def test_one_of_several_writers_wins(spark, tmp_path):
    folder = str(tmp_path / "store")
    start, outcomes = threading.Barrier(4), {}

    def write(k):
        rows = spark.createDataFrame([(k, "a"), (k, "b")], SCHEMA)
        start.wait()
        try:
            staged.commit(spark, folder, "same", {"recipes": rows})
            outcomes[k] = "won"
        except ValueError as e:
            outcomes[k] = str(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    (winner,) = [k for k, o in outcomes.items() if o == "won"]
    assert len(outcomes) == 4 and all("published" in o for k, o in outcomes.items() if k != winner)
    got = [tuple(r) for r in staged.read_table(spark, folder, "recipes", SCHEMA).collect()]
    assert sorted(got) == [(winner, "a"), (winner, "b")]
    assert staged.published(spark, folder) == ["same"]


def test_a_name_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "deep" / "name")
    results = []
    threads = [threading.Thread(target=lambda i=i: results.append((staged.place_once(spark, path, f"text {i}"), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    (winner,) = [i for won, i in results if won]
    assert open(path).read() == f"text {winner}" and len(list((tmp_path / "deep").iterdir())) == 1


def test_names_of_batches(spark, tmp_path):
    for bad in ("", "a/b", "_x", ".x", "a=b"):
        with pytest.raises(ValueError, match="no name"):
            staged.commit(spark, str(tmp_path), bad, {})
    staged.commit(spark, str(tmp_path), "empty", {"recipes": spark.createDataFrame([], SCHEMA)})
    assert staged.read_table(spark, str(tmp_path), "recipes", SCHEMA).count() == 0
    assert staged.read_table(spark, str(tmp_path), "other", SCHEMA).columns == ["id", "name"]


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.range(60).select(F.col("id"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    rows.repartition(4).write.parquet(source)
    write = staged.each_batch(folder, "log", lambda df: {"recipes": df, "ids": df.select("id")})
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds nothing new
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    write(rows, 0)  # a batch that runs again after its sink was done
    assert sorted(r.id for r in staged.read_table(spark, folder, "recipes", SCHEMA).collect()) == list(range(60))
    assert staged.read_table(spark, folder, "ids", "id long").count() == 60 and staged.published(spark, folder)[0] == "log-000000000000"


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(50):
            z.writestr(f"{i}.paprikarecipe", gzip.compress(json.dumps({"name": f"r{i}"}).encode()) if i != 7 else gzip.compress(b"{}")[:-9])
        z.writestr("notes.txt", b"x")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    read = archive(spark, str(tmp_path / "*.zip"), members=10)
    assert read.rdd.getNumPartitions() == 7
    rows = read.withColumn("task", F.spark_partition_id()).collect()
    good = [r for r in rows if r.error is None]
    assert sorted(json.loads(r.record)["name"] for r in good) == sorted(f"r{i}" for i in range(50) if i != 7) and len({r.task for r in good}) == 5
    assert sorted((r.archive.rsplit("/", 1)[1], r.entry) for r in rows if r.error) == [("broken.zip", None), ("many.zip", "7.paprikarecipe")]
    assert archive(spark, str(tmp_path / "many.zip")).count() == 50 and archive(spark, str(tmp_path / "no*.rar")).count() == 0


def test_an_sqlite_table_equals_its_parquet(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderkey", "o_orderstatus", "cast(o_totalprice AS double) AS price", "nullif(o_orderpriority, '5-LOW') AS priority", "cast(o_orderdate AS string) AS day")
    path = str(tmp_path / "kitchen.db")
    database.save_sqlite(rows, path, "orders")
    read = database.sqlite_table(spark, path, "orders", 5)
    assert read.rdd.getNumPartitions() == 5 and read.dtypes == rows.dtypes
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(read) == plain(rows)
    cases = {
        "o_orderkey < 100 AND price >= 1000.5": [("o_orderkey", "<", 100), ("price", ">=", 1000.5)],
        "priority IS NULL": [("priority", "is null")],
        "priority = '1-URGENT' AND o_orderkey IN (1, 2, 3, 500)": [("priority", "=", "1-URGENT"), ("o_orderkey", "in", [1, 2, 3, 500])],
        "day LIKE '1995-%' AND priority IS NOT NULL": [("day", "starts with", "1995-"), ("priority", "is not null")],
        "priority LIKE '%MED%'": [("priority", "contains", "MED")],
        "priority <> '1-URGENT'": [("priority", "<>", "1-URGENT")],
        "o_orderkey < 0": [("o_orderkey", "<", 0)],
        "false": [("o_orderkey", "in", [])],
    }
    for condition, where in cases.items():
        some = database.sqlite_table(spark, path, "orders", 3, where)
        assert plain(some.select("o_orderkey", "day")) == plain(rows.where(condition).select("o_orderkey", "day")), condition
        assert some.where("o_orderstatus = 'F'").count() == rows.where(condition).where("o_orderstatus = 'F'").count()
    assert read.where("o_orderkey < 0").count() == 0 and read.where("price < 0 OR o_orderstatus = 'F'").count() == rows.where("o_orderstatus = 'F'").count() and read.count() == rows.count()
    with pytest.raises(Exception, match="no table"):
        database.sqlite_table(spark, path, "nothing").count()
    with pytest.raises(ValueError, match="no condition"):
        database.sqlite_table(spark, path, "orders", 1, [("day", "like", "x")])
    odd = str(tmp_path / "odd.db")
    database.save_sqlite(spark.createDataFrame([(1, 'a"b')], 'id long, `odd "name" here` string'), odd, 'a "table"')
    assert database.sqlite_table(spark, odd, 'a "table"', 9, [('odd "name" here', "contains", '"')]).count() == 1


def test_a_rebuild_replaces_what_it_lacks(spark, tmp_path):
    from larder.operators.rows import rebuild_changes
    from larder.sources.library import library

    folder, schema = str(tmp_path / "store"), "ingredient_id string, month int"
    first = library(spark, [{"id": "leek", "season": [1, 2, 12]}, {"id": "pea", "season": [5]}])
    then = library(spark, [{"id": "leek", "season": [1, 2]}, {"id": "plum", "season": [8]}])
    read = lambda: staged.read_latest(spark, folder, "ingredient_seasons", schema)
    assert read().count() == 0
    staged.rebuild(spark, folder, "v1", {"ingredient_seasons": first["ingredient_seasons"]})
    assert sorted(map(tuple, read().collect())) == [("leek", 1), ("leek", 2), ("leek", 12), ("pea", 5)]
    changes = rebuild_changes(read(), then["ingredient_seasons"]).collect()
    assert sorted(map(tuple, changes)) == [("leek", 12, "gone"), ("pea", 5, "gone"), ("plum", 8, "new")]
    staged.rebuild(spark, folder, "v2", {"ingredient_seasons": then["ingredient_seasons"]})
    staged.rebuild(spark, folder, "v3", {"other": then["regions"]})
    assert sorted(map(tuple, read().collect())) == [("leek", 1), ("leek", 2), ("plum", 8)]
    assert rebuild_changes(read(), then["ingredient_seasons"]).count() == 0


def test_step_links_come_back_sign_by_sign(spark):
    from larder.functions.text import from_step_parts, step_parts

    steps = ["", "plain", "[[a]]", "[[a|b]]", "x[[a|b]]y[[c]]z", "[[a]][[b|c]]", "[[]] [[|x]] [[a|]] [[a|b|c]] [[a]", "line\n\n[[a]]\n", "\n", "[[é ☃|𝔘]] [[ [[a]] ]]", "[[a\nb]] [[c]]", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i long, s string").withColumn("p", step_parts(F.col("s"))).withColumn("back", from_step_parts(F.col("p")))
    rows = {r.i: r for r in df.collect()}
    assert [rows[i].back for i in range(len(steps))] == steps
    assert [tuple(p) for p in rows[4].p[0]] == [("x", None, None), (None, "a", "b"), ("y", None, None), (None, "c", None), ("z", None, None)]
    assert rows[0].p == [[]] and [len(line) for line in rows[7].p] == [1, 0, 1, 0] and rows[11].p is None
    assert [tuple(p)[1:] for p in rows[6].p[0] if p.id] == [("a", "b|c")]
