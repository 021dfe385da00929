"""Writes, imports, staged tables and samples on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from larder.functions import amounts, steps, text
from larder.operators import imports, kitchen, slugs
from larder.sources import files, library, staged


def test_staged_batches_publish_at_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    schema = "id long, name string"
    assert staged.read_table(spark, folder, "recipes", schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    staged.commit(spark, folder, "b1", {"recipes": rows, "lines": rows.select("id")})
    # a batch that breaks off before it is published isn't read, and can be written again
    rows.write.parquet(f"{folder}/staged/b2/recipes")
    assert staged.read_table(spark, folder, "recipes", schema).count() == 2
    staged.commit(spark, folder, "b2", {"recipes": rows.where("id = 2")})
    assert staged.published(spark, folder) == ["b1", "b2"]
    assert sorted(r.id for r in staged.read_table(spark, folder, "recipes", schema).collect()) == [1, 2, 2]
    with pytest.raises(ValueError, match="published"):
        staged.commit(spark, folder, "b1", {"recipes": rows})


def test_library_tables(spark):
    tables = library.library(spark, [{"id": "fig", "name": "Fig", "season": [8, 9], "regions": ["Spain", "Greece"]}, {"id": "oat", "name": "Oat", "season": [], "regions": None}])
    assert sorted((r.ingredient_id, r.month) for r in tables["ingredient_seasons"].collect()) == [("fig", 8), ("fig", 9)]
    assert sorted((r.id, r.name) for r in tables["regions"].collect()) == [(1, "Greece"), (2, "Spain")]
    assert sorted((r.ingredient_id, r.region_id, r.position) for r in tables["ingredient_regions"].collect()) == [("fig", 1, 1), ("fig", 2, 0)]
    assert tables["ingredients"].count() == 2


def test_import_of_a_page(spark):
    page = (
        '<script type="application/ld+json">{"@type":"Recipe","name":"Açaí Bowl","recipeIngredient":["Habanero Syrup","2 tbsp oil each","1 (, chopped) onion"],"recipeInstructions":["Habanero Syrup -","Blend."],"recipeYield":"makes 3"}</script>'
    )
    source = spark.createDataFrame([(5, "https://e.com/r?utm_source=x", page), (6, "https://e.com/r", page), (7, None, None)], "id long, url string, text string")
    known = spark.createDataFrame([(3, "e.com/r"), (2, "e.com/q"), (9, "e.com/r")], "id long, source_key string")
    taken = spark.createDataFrame([("acai-bowl",)], "slug string")
    got = {r.id: r for r in imports.preview(source, taken, known).collect()}
    assert got[7].refusal == "NO_STRUCTURED_DATA" and got[7].slug is None
    assert (got[5].slug, got[6].slug, got[5].duplicate_of, got[5].servings) == ("acai-bowl-2", "acai-bowl-3", 3, "3")
    first, second, third = got[5].ingredients
    assert (first.is_heading, first.raw_text, first.qty, first.label) == (1, "Habanero Syrup", None, None)
    assert (second.qty, second.quantity, second.unit, second.label) == ("2 tbsp", "2", "tbsp", "oil each") and third.raw_text == "1 (, chopped) onion"
    assert [(s.is_heading, s.text) for s in got[5].steps] == [(1, "Habanero Syrup"), (0, "Blend.")]
    assert {(f.position, f.flag) for f in got[5].review_flags} == {(None, "imported_via"), (0, "section_suggested"), (1, "each_multi"), (2, "cleaned_paren_comma")}
    assert all(f.reason for f in got[5].review_flags)
    tables = imports.staged(source, taken, 7)
    assert {k: v.count() for k, v in tables.items()} == {"recipes": 2, "recipe_ingredients": 6, "recipe_steps": 4, "import_flags": 8}
    assert {r.owner for r in tables["recipes"].collect()} == {7}


def test_slugs_that_meet(spark):
    def plainly(batch, taken):
        seen, out = set(taken), []
        for entry, base in sorted(batch):
            slug, n = base, 2
            while slug in seen:
                slug, n = f"{base}-{n}", n + 1
            seen.add(slug)
            out.append((entry, slug))
        return out

    batch = [(1, "x"), (2, "x"), (30_001, "x-2"), (4, "x"), (5, "y"), (6, "y"), (60_000, "y"), (8, "z-3"), (9, "z"), (10, "z"), (11, "z"), (12, "q-7"), (13, "q-7")]
    for taken in ([], ["x"], ["y-2", "q-7-2"], ["z-3", "z"]):
        got = slugs.mint(spark.createDataFrame(batch, "entry long, base string"), spark.createDataFrame([(t,) for t in taken], "slug string"))
        assert sorted(map(tuple, got.collect())) == plainly(batch, taken), taken


def test_photos(spark):
    recipes = spark.createDataFrame([(1, 7, None), (2, 8, "old.jpg"), (3, 9, None)], "id long, owner long, image string")
    cooks = spark.createDataFrame([(10, 1, 7), (11, 3, 7)], "id long, recipe_id long, user_id long")
    photos = spark.createDataFrame([(100, 1, 7, "a", 4), (101, 2, 8, "old.jpg", 0), (102, 2, 8, "b", None)], "id long, recipe_id long, user_id long, path string, position long")
    asked = [(1, 1, 7, None, "p1", " hi "), (2, 1, 7, 10, "p2", " "), (3, 1, 8, None, "p3", None), (4, 3, 7, 11, "p4", None), (5, 3, 7, 10, "p5", None), (6, 9, 7, None, "p6", None), (7, 3, 8, 11, "p7", None), (8, 1, 7, None, "p8", "x" * 61)]
    got = {r.id: tuple(r)[2:] for r in kitchen.attach_photos(spark.createDataFrame(asked, "id long, recipe_id long, user_id long, cook_log_id long, path string, caption string"), recipes, cooks, photos).collect()}
    assert got == {
        1: (None, "hi", 5, True), 2: (None, None, 6, False), 3: ("not your recipe", None, None, False), 4: (None, None, 0, False), 5: ("cook not found for this recipe", None, None, False),
        6: ("recipe not found", None, None, False), 7: ("not your cook", None, None, False), 8: ("caption too long", None, None, False),
    }
    left, cleared, free = kitchen.delete_photos(spark.createDataFrame([(101, 8), (100, 9)], "photo_id long, user_id long"), photos, recipes)
    assert sorted(r.id for r in left.collect()) == [100, 102]
    assert {r.id: r.image for r in cleared.collect()} == {1: None, 2: None, 3: None} and [r.path for r in free.collect()] == ["old.jpg"]


def test_seed_rows_and_parts(spark):
    schema = "recipe_id string, ingredients array<struct<heading:string,item:string,qty:string,label:string,note:string,text:string>>"
    rows = spark.createDataFrame([("pie", [("Crust", None, None, None, None, None), (None, "flour", "2 cups", "flour", ", sifted", None), (None, None, "a pinch", None, None, "salt"), (None, None, None, None, None, None)])], schema)
    got = kitchen.seed_rows(rows).orderBy("position").collect()
    assert [(r.is_heading, r.qty, r.quantity, r.unit, r.ingredient_id, r.raw_text) for r in got] == [
        (1, None, None, None, None, "Crust"), (0, "2 cups", "2", "cups", "flour", "2 cups flour, sifted"), (0, "a pinch", "a pinch", "", None, "salt"), (0, None, "", "", None, ""),
    ]
    given = spark.createDataFrame([("2 cups", None, None), ("x", "3", "cloves"), (None, "pinch", None), (None, None, None)], "a string, b string, c string")
    parts = given.select(amounts.row_parts(F.col("a"), F.col("b"), F.col("c")).alias("p")).select("p.*").collect()
    assert [tuple(p) for p in parts] == [("2 cups", "2", "cups"), ("3 cloves", "3", "cloves"), ("pinch", "pinch", ""), (None, "", "")]


def test_tags_and_signs(spark):
    df = spark.createDataFrame([("a · b·  · c",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(text.split_tags(F.col("x"))).collect()] == [["a", "b", "c"], [], []]
    df = spark.createDataFrame([("1 1/2 cups",), ("1/4 tsp and 11/4",), ("2/3",), ("5/16",)], "x string")
    assert [r[0] for r in df.select(amounts.glyph_fractions(F.col("x"))).collect()] == ["1½ cups", "¼ tsp and 11/4", "⅔", "5/16"]
    assert [r[0] for r in spark.createDataFrame([("Serves 6 to 8",), ("one pan",), (None,)], "x string").select(kitchen.servings_base(F.col("x"))).collect()] == [6, None, None]


def test_tokens_of_odd_lines(spark):
    lines = [None, "", "{{}} and {{!}}", "a﷐b 2 cups﷑", "1 to 2 to 3 cups", "½", "no numbers", "٣ cups"]
    got = spark.createDataFrame([(t,) for t in lines], "x string").select(steps.tokens(F.col("x")).alias("t"), steps.spans(F.col("x")).alias("s")).collect()
    assert [[t.category for t in r.t] for r in got] == [[], [], ["marked_scale", "marked_lock"], ["heuristic_scale"], ["unitless", "heuristic_scale"], ["unitless"], [], ["heuristic_scale"]]
    assert got[0].s is None and got[1].s == [] and [s.text for s in got[3].s] == ["ab ", "2 cups"]


def test_snapshots_and_samples(spark):
    contents = spark.createDataFrame([(1, "{a}"), (2, "{b}")], "recipe_id long, content string")
    cooks = spark.createDataFrame([(5, 1, 7), (6, 3, 7)], "id long, recipe_id long, user_id long")
    have = spark.createDataFrame([(2, "original"), (1, "cook")], "recipe_id long, reason string")
    born = spark.createDataFrame([(1, 9), (1, 8), (2, 9)], "recipe_id long, user_id long")
    assert sorted(map(tuple, kitchen.capture_snapshots(contents, cooks, have, born).collect()), key=str) == [(1, "cook", 5, 7, "{a}"), (1, "original", None, 8, "{a}")]
    rows = spark.range(20)
    got = kitchen.varied_sample(rows, [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 3), ("none", F.col("id") > 99)], target=5).collect()
    assert [(r.id, r.reason) for r in got[:1]] == [(0, "even")] and [r.reason for r in got[1:]] == ["random"] * 4 and len({r.id for r in got}) == 5
    assert kitchen.varied_sample(rows.where("false"), [("even", F.col("id") % 2 == 0)]).count() == 0


def test_archive_records_have_one_shape(spark):
    png = "iVBORw0KGgoAAAANSUhEUg=="
    record = '{"name":" \\"Pie\\" ","ingredients":"1 egg\\n\\n salt \\n","directions":"Mix.\\n\\nBake.","categories":["a"],"rating":4,"photo_data":"' + png + '","photos":[{"filename":"f","data":"AAAA"},{"name":"n","data":"?"}]}'
    got = files.normalized(spark.createDataFrame([("a", record), ("b", "{}"), ("c", None)], "entry string, record string")).orderBy("entry").collect()
    a, b = got
    assert (a.name, a.name_raw, a.ingredient_lines, a.blank_breaks, a.directions, a.categories, a.rating) == ("Pie", ' "Pie" ', ["1 egg", "salt"], 2, ["Mix.", "Bake."], ["a"], 4)
    assert (a.primary_photo.type, a.primary_photo.bytes, a.primary_photo.b64_len) == ("PNG", 16, len(png)) and [i.type for i in a.images] == ["unknown(000000)", "DECODE-ERROR"]
    assert (b.name, b.ingredient_lines, b.blank_breaks, b.source, b.images, b.primary_photo, b.rating) == ("", [], 0, "", [], None, None)
    assert [r[0] for r in spark.createDataFrame([('""',), ('"',), ('"a" b"',)], "x string").select(text.unquoted(F.col("x"))).collect()] == ["", '"', 'a" b']


def test_owner_must_be_one(spark):
    users = spark.createDataFrame([(1, "A@e.org "), (2, "b@e.org")], "id long, email string")
    assert kitchen.resolve_owner(users, " a@E.org").first().id == 1 and kitchen.resolve_owner(users.where("id = 2")).first().id == 2
    for few in (kitchen.resolve_owner(users), kitchen.resolve_owner(users, "x@e.org")):
        with pytest.raises(Exception, match="no single owner"):
            few.collect()
