"""Every query with an oracle against DuckDB, the others against what must hold."""

from collections import Counter

import duckdb
import pytest

from larder.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def bag(rows, names):
    return Counter(repr(tuple(plain(r[c]) for c in sorted(names))) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    asked = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(asked.columns)
    want = bag([dict(zip(asked.columns, r, strict=True)) for r in asked.fetchall()], df.columns)
    assert bag(df.collect(), df.columns) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs_twice_alike(spark, name):
    df = QUERIES[name](spark, SF)
    first = bag(df.collect(), df.columns)
    assert first and bag(QUERIES[name](spark, SF).collect(), df.columns) == first


def test_filters_reach_the_scan(spark):
    plan = QUERIES["p_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "IsNotNull(o_orderdate)" not in plan.split("ReadSchema")[1].split("\n")[0]
    wide = QUERIES["a3_recipe_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in wide and "props" not in wide


def test_headings_are_safe(spark):
    assert QUERIES["c9_heading_sync"](spark, SF).where("unsafe").count() == 0


def test_change_queries_read_every_document_to_its_end(spark, tmp_path):
    from larder.plans.understanding import _snapshots

    texts = [(i, "\n".join(f"line {n} of {i}" for n in range(60))) for i in (3, 4, 7)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    old = {r.recipe_id: r.old for r in _snapshots(spark, d).collect()}
    assert sorted(old) == [3, 4, 7] and all(f"line 59 of {i}" in s for i, s in old.items())
    assert {r.recipe_id for r in QUERIES["c7_changes"](spark, d).where("kind <> 'field'").collect()} == {3, 4, 7}
    assert QUERIES["c1_field_changes"](spark, d).count() == 0
    assert [r.n for r in QUERIES["c9_heading_sync"](spark, d).collect()] == [60, 60, 60]


def test_every_survivors_hero_keeps_its_file(spark):
    from larder.plans.state import unreferenced

    recipes = spark.createDataFrame([(1, "test", None), (2, "app", "img/a"), (20000, "seed", "img/b"), (4, "test", "img/c")], "id long, source string, image string")
    photos = spark.createDataFrame([(1, "img/a"), (1, "img/b"), (1, "img/c"), (1, "img/d"), (2, "img/d")], "recipe_id long, path string")
    assert [r.path for r in unreferenced(photos, recipes, recipes).collect()] == ["img/c"]
    assert "u5_all_unreferenced_files" in QUERIES


def test_inserts_captions_and_sets_are_whole(spark):
    from larder.plans.state import CAPTION_MAX, insertable, shared

    recipes = spark.createDataFrame([(1, "app"), (499, "app"), (120000, "seed"), (120001, "seed")], "id long, source string")
    log = spark.createDataFrame([(1, "app"), (120000, "import")], "recipe_id long, source string")
    assert sorted(tuple(r) for r in insertable(recipes, log).collect()) == [(499, "app", False), (120000, "seed", True), (120001, "seed", False)]
    posts = spark.createDataFrame([(1, 7, " post 123456 "), (2, 8, "x" * 280), (3, 8, "x" * 281), (4, 9, None)], "id long, user_id long, caption string")
    users = spark.createDataFrame([(7, False), (8, True), (9, False)], "id long, is_admin boolean")
    assert sorted(tuple(r) for r in shared(posts, users, CAPTION_MAX).collect()) == [(1, "post 123456", True), (2, "x" * 280, True), (4, None, False)]
    whole = QUERIES["d22_all_guarded_insert"](spark, SF)
    assert whole.where("id >= 500").count() == spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey >= 500").count()


def test_threads_hold_whole_comments_and_ordinals_span_ranges(spark):
    from larder.plans.reads import numbered

    ids = [-7, 0, 3, 9, 10, 11, 35, 36, 90]
    got = numbered(spark.createDataFrame([(i,) for i in reversed(ids)], "id long"), 10)
    assert sorted((r.ordinal, r.id) for r in got.collect()) == list(enumerate(ids))
    said = {f"{r.turn}:{r.text}" for r in spark.read.parquet(f"{SF}/conversations.parquet").where("length(text) > 40").collect()}
    threads = [r.thread for r in QUERIES["a16_all_threads"](spark, SF).collect()]
    assert said and any(s in t for t in threads for s in said)
