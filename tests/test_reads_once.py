"""Pages are read once, however many tables and filters name them."""

from larder.operators import imports

PAGE = """<script type="application/ld+json">{"@type":"Recipe","name":"Pie","recipeIngredient":["2 cups flour","salt"],"recipeInstructions":["Mix."]}</script>"""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([(i, f"http://a.io/{i}", PAGE) for i in range(3)], "id long, url string, text string")
    taken = spark.createDataFrame([("pie",)], "slug string")
    tables = imports.staged(pages, taken, 7)
    shown = imports.preview(pages, taken, spark.createDataFrame([], "id long, source_key string"))
    for df in (*tables.values(), shown):
        assert plan(df).count("page_record(") == 0 and len(plan(df)) < 100_000
    assert sorted(r.id for r in tables["recipes"].collect()) == ["pie-2", "pie-3", "pie-4"]
    assert tables["recipe_ingredients"].count() == 6
    assert plan(imports.read(pages).where("refusal IS NULL")).count("page_record(") == 1
