"""Golden cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from larder.functions import amounts, lines, pages, steps, text, times, urls, weights


def run(spark, values, *columns, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()


def one(spark, values, column, schema="x string"):
    return [r.c0 for r in run(spark, values, column, schema=schema)]


X = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    globals()["X"] = F.col("x")


def test_split_quantity(spark):
    cases = {"2 tablespoons": ("2", "tablespoons"), "1 1/2 tsp": ("1 1/2", "tsp"), "10 to 12": ("10 to 12", ""), "4 cloves": ("4", "cloves"), "1 medium head": ("1", "medium head"), "2 lb / 1 kg": ("2 lb / 1 kg", ""), "3 + 2 tbsp": ("3 + 2 tbsp", ""), "pinch": ("pinch", ""), "2-3 cups": ("2-3", "cups"), "": ("", ""), None: ("", "")}
    got = one(spark, list(cases), amounts.split_quantity(X))
    assert [(r.quantity, r.unit) for r in got] == list(cases.values())


def test_parse_amount(spark):
    got = one(spark, ["½ cup cold water", "1 and 1/4 cups (285g) canned pumpkin puree*", "1½ cups", "1 to 2 tbsp oil", "2–3 eggs", "salt", "1/0 cup"], amounts.parse_amount(X))
    assert [(r.amount, r.value, r.unit) for r in got] == [("½", 0.5, "cup"), ("1 1/4", 1.25, "cups"), ("1½", 1.5, "cups"), ("1 to 2", None, "tbsp"), ("2–3", None, ""), ("", None, ""), ("1/0", None, "cup")]
    assert (got[3].lo, got[3].hi) == (1, 2) and got[0].name == "cold water" and got[5].name == "salt"


def test_classify_line(spark):
    want = {
        "SAUCE:": "section", "FOR THE PASTRY": "section", "**Other Ingredients:**": "section", "crust": "section", "salt": "flagged", "2 EGGS": "ingredient", "Day 2": "section", "Wet Ingredients": "section", "Flour Dredge": "section", "2 x 6oz steaks": "flagged", "1 tsp each salt and pepper": "flagged",
    }
    got = one(spark, list(want), lines.classify_line(X))
    assert [r.kind for r in got] == list(want.values())
    by = dict(zip(want, got, strict=True))
    assert by["**Other Ingredients:**"].name == "Other Ingredients:" and by["crust"].flags == ["section_suggested"] and by["salt"].flags == ["ambiguous_section"]
    assert by["2 x 6oz steaks"].flags == ["multiplier"] and by["1 tsp each salt and pepper"].flags == ["each_multi"]


def test_weights_of_lines(spark):
    want = {
        "14 cups (250g) dried chickpeas": (250, "14 cups", "dried chickpeas"),
        "100 g (1 cup) granulated sugar": (100, "1 cup", "granulated sugar"),
        "1 cup (250g) flour": (250, "1 cup", "flour"),
        "2 teaspoons / 6 g active dry yeast": (None, "/ 6 g", "active dry yeast"),
        "3 tbsp Thai tea mix (": (None, None, "Thai tea mix"),
        "1 can (15 ounces) chickpeas": (425, None, "chickpeas"),
        "1 (12-ounce) can milk": (340, None, "milk"),
        "1 8-ounce package cheese": (227, None, "cheese"),
        "1 x 397 g can condensed milk": (397, None, "condensed milk"),
        "2 cups flour (16 Tbsp; 226g)": (226, "2 cups", "flour (16 Tbsp; 226g)"),
    }
    got = one(spark, list(want), lines.classify_line(X))
    assert [(r.grams, r.secondary, r.name) for r in got] == list(want.values())
    assert got[5].amount == "1" and got[5].unit == "can" and got[5].kind == "ingredient"
    declined = one(spark, ["2 cups rice (from 1/2 cup (15g) soaked)", "1 kg chicken (~250g/8oz each)", "1 (, chopped) onion", "1 tbsp soy ((Note 4))"], lines.classify_line(X))
    assert declined[0].grams is None and "grams_declined" in declined[0].flags and declined[1].grams is None
    assert declined[2].flags == ["cleaned_paren_comma"] and declined[3].flags == ["cleaned_double_paren"]


def test_steps_and_servings(spark):
    got = one(spark, ["prepare your pan -", "FILLING", "Bake it.", "Make the crust:"], lines.classify_step(X))
    assert [(r.is_heading, r.text) for r in got] == [(True, "prepare your pan"), (True, "FILLING"), (False, "Bake it."), (True, "Make the crust:")]
    assert one(spark, [["Make the crust:", "Bake.", "HABANERO SYRUP"]], lines.step_hints(X), "x array<string>") == [["crust", "habanero syrup"]]
    assert one(spark, ["4", " 12 ", "Serves 6", "one 9x13 pan", "makes: 8", "5 portions", "", None], lines.parse_servings(X)) == [4, 12, 6, None, 8, 5, None, None]


def test_spans(spark):
    want = {
        "add 1 to 2 tablespoons more ice water": ["1 to 2 tablespoons"], "bake 20 to 25 minutes": [], "bake at 350°F": [], "9x13 pan": [], "roll to 1/4-inch thick": [],
        "stir in {{2 tbsp}} oil": ["2 tbsp"], "{{!350°F}}": [], "{{350°F}}": ["350°F"], "divide into 4 pieces": [], "add 2 cups flour and bake 1 hour at 350°F": ["2 cups"],
    }
    got = one(spark, list(want), steps.client_spans(X))
    assert [[s.text for s in r if s.t == "scale"] for r in got] == list(want.values())
    for line, r in zip(want, got, strict=True):
        assert "".join(s.text for s in r) == line.replace("{{!", "").replace("{{", "").replace("}}", "")
        assert all(a.t != "plain" or b.t != "plain" for a, b in zip(r, r[1:], strict=False))
    assert [s.category for s in one(spark, ["divide into 4 pieces"], steps.spans(X))[0]] == ["plain", "unitless", "plain"]


def test_scaling(spark):
    assert one(spark, [0.25, 1.5, 187.5, 0.0, 2.0, 1234.0], amounts.format_amount(X), "x double") == ["¼", "1½", "188", "0", "2", "1,234"]
    got = run(spark, [("1½ cups", 2.0), ("1 to 2 tablespoons", 0.5), ("1 to 1 tbsp", 0.5), ("pinch", 2.0), ("2 tbsp", 0.0), ("2 lb / 1 kg", 2.0)], amounts.scale(X, F.col("f")), schema="x string, f double")
    assert [r.c0 for r in got] == ["3 cups", "½ to 1 tablespoons", "½ tbsp", "pinch", "2 tbsp", "4 lb / 2 kg"]
    assert [r.c0 for r in run(spark, [("2 medium", 1.5), ("2 medium", 0.1)], amounts.scale_count(X, F.col("f")), schema="x string, f double")] == ["3 medium", "~1 medium"]
    assert [r.value for r in one(spark, ["3 + 2 tbsp", "1 cup + 2 tbsp"], amounts.summed(X))] == [5, None]
    assert one(spark, ["1 lb", "2 tbsp", "1 cup"], amounts.to_metric(X, F.lit(0.5))) == ["454 g", None, "~118 g"]


def test_units_and_volumes(spark):
    assert one(spark, ["1 Teaspoon", "2 fluid ounces", "3 litres ", None], amounts.canonical_units(X)) == ["1 tsp", "2 fl oz", "3 liter", ""]
    assert one(spark, ["2 cups", "½cup", "cupboard", "3 fl oz", None], amounts.has_volume_unit(X)) == [True, False, False, True, False]
    assert [round(v, 4) if v else v for v in one(spark, ["1 cup", "2 1/4 teaspoons", "1/2 cup", "3 sticks", ""], amounts.reference_ml(X))] == [236.588, 11.0901, 118.294, None, None]


def test_weight_matching(spark):
    chart = [(1, "bread flour", 0.5), (2, "All-Purpose Flour", 0.51), (3, "Sugar (granulated white)", 0.84), (4, "olive oil", 0.85), (5, "Salt (table)", 1.22), (6, "Salt (kosher Diamond Crystal)", 0.54), (7, "Salt (kosher Mortons)", 1.08)]
    rows = spark.createDataFrame([(i, n, g, True) for i, n, g in chart], "ordinal int, display_name string, grams_per_ml double, convert boolean").withColumn("lookup_key", weights.name_key(F.col("display_name")))
    want = {"All-Purpose Flour": 0.51, "sugar": 0.84, "EVOO": 0.85, "extra-virgin olive oil": 0.85, "kosher salt": 0.54, "salt": None, "sea salt": None, "caster sugar": None, "dragonfruit": None, "olive oil, divided": 0.85, None: None, "": None}
    got = weights.match_weights(spark.createDataFrame([(n,) for n in want], "n string"), "n", rows).collect()
    assert {r.n: r.weight and r.weight.grams_per_ml for r in got} == want


def test_source_keys(spark):
    same = ["https://example.com/r/1", "http://example.com/r/1", "https://www.example.com/r/1/", "https://amp.example.com/r/1", "https://example.com/r/1/amp", "https://example.com/r/1/amp/", "https://example.com:443/r/1", "https://EXAMPLE.com/r/1#method", "https://example.com/r/1?utm_source=x&fbclid=y&ref=z", "https://example.com/r/1?amp=1"]
    assert set(one(spark, same, urls.source_key(X))) == {"example.com/r/1"}
    a, b, c, d, e, f, g, h = one(spark, ["https://e.com/r?b=2&a=1", "https://e.com/r?a=1&b=2", "https://e.com/R", "https://e.com:8080/r", "https://e.com/?p=12", "ftp://e.com/r", "https://e.com:bad/", None], urls.source_key(X))
    assert a == b == "e.com/r?a=1&b=2" and c == "e.com/R" and d == "e.com:8080/r" and e == "e.com?p=12" and f == g == h == ""
    assert one(spark, ["https://e.com/?q=a%20b+c&z=", "https://e.com/?q=%zz"], urls.source_key(X)) == ["e.com?q=a+b+c&z=", "e.com?q=%25zz"]
    private = ["http://localhost/x", "http://10.1.2.3/", "http://192.168.0.1:80/", "http://[::1]/", "http://169.254.1.1/", "http://172.20.0.1"]
    assert one(spark, private, urls.is_private_host(X)) == [True] * 6
    assert one(spark, ["http://8.8.8.8/", "http://example.com", "http://172.32.0.1", None], urls.is_private_host(X)) == [False] * 4


def test_slugs_and_text(spark):
    assert one(spark, ["Acqua Pazza", "Mom's Thai-Style Curry!", "Açaí Bowl", "!!!", None], text.slug_base(X)) == ["acqua-pazza", "mom-s-thai-style-curry", "acai-bowl", "recipe", "recipe"]
    assert one(spark, ["Açaí Bowl", " A  b_c "], text.slug(X)) == ["açaí-bowl", "a-b-c"]
    assert one(spark, [" a\t", "x"], text.strip(X)) == ["a", "x"]
    assert one(spark, ["see [[salt|Sea salt]] and [[a|b]]"], F.to_json(text.links(X))) == ['[{"id":"salt","label":"Sea salt"},{"id":"a","label":"b"}]']
    assert one(spark, ['"quoted"', "plain", '"', None], text.unquoted(X)) == ["quoted", "plain", '"', ""]
    assert one(spark, ["a\r\n\n b \n"], text.filled_lines(X)) == [["a", "b"]]
    assert one(spark, ["<b>Salt</b> &amp; pepper&nbsp;", "&lt;b&gt;"], text.plain_html(X)) == ["Salt & pepper", "<b>"]
    assert one(spark, [["a ", "", "b"], []], text.joined_tags(X), "x array<string>") == ["a · b", None]
    assert one(spark, ["é", "e"], text.is_non_ascii(X)) == [True, False]
    assert len(one(spark, ["w " * 99], text.shortened(X))[0]) == 66


def test_times(spark):
    assert one(spark, ["PT20M", "PT1H15M", "P1DT2H", "PT45M30S", "PT0M", "x", "P2W"], times.duration_text(X)) == ["20 min", "1 hr 15 min", "26 hr", "45 min", "", "", "336 hr"]
    now = F.lit("2026-07-10 12:00:00")
    stamps = ["2026-07-10 11:59:30", "2026-07-10 11:55:00", "2026-07-10 09:00:00", "2026-07-08 12:00:00", "2026-07-03 11:00:00", "2020-01-15 00:00:00", "soon", None]
    assert one(spark, stamps, times.relative_time(X, now)) == ["just now", "5m", "3h", "2d", "Jul 3", "Jan 15, 2020", "soon", ""]
    assert one(spark, ["2024-01-02", "2024-01-02T03:04:05", "bad"], times.expiry(X)) == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", None]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>none</p>", {"refusal": "NO_STRUCTURED_DATA"}),
        ('<script type="application/ld+json">{bad</script>', {"refusal": "NO_STRUCTURED_DATA"}),
        ('<script type="application/ld+json">{"@type":["Article","Thing"]}</script>', {"refusal": "NOT_A_RECIPE", "context": ["Article", "Thing"]}),
        ('<script type="application/ld+json">{"@type":"Recipe","name":"x"}</script>', {"refusal": "INCOMPLETE", "context": ["ingredients", "steps"]}),
    ],
)
def test_pages_refused(body, want):
    assert pages.read_page(body) == want


def test_page_read(spark):
    body = """<script type='application/ld+json'>{"@graph":[{"@id":"#a"},{"@type":"Recipe","name":"Pie &amp; <b>Co</b>","author":{"@id":"#a"},"recipeYield":["4","4 servings"],
      "recipeCategory":"Dessert, Pie","recipeCuisine":["Pie","French"],"prepTime":"PT1H","cookTime":{"maxValue":"PT90M"},"recipeIngredient":["1 cup flour",""," salt "],
      "recipeInstructions":[{"@type":"HowToStep","text":"Mix."},{"@type":"HowToSection","name":"Crust","itemListElement":[{"text":"Roll."}]}]},{"@id":"#a","name":"Nagi"}]}</script>"""
    r = one(spark, [body, None], pages.page_record(X))
    assert r[0].name == "Pie & Co" and r[0].source == "Nagi" and r[0].servings_raw == "4" and r[0].categories == ["Dessert", "Pie", "French"]
    assert r[0].directions == ["Mix.", "Crust:", "Roll."] and r[0].ingredient_lines == ["1 cup flour", "salt"] and (r[0].prep_time, r[0].cook_time) == ("1 hr", "1 hr 30 min")
    assert r[0].refusal is None and r[1].refusal == "NO_STRUCTURED_DATA"


def test_descriptors(spark):
    from larder.functions import names

    want = {
        "large cloves of garlic": ("large cloves", "garlic"), "small bunch of parsley (chopped)": ("small bunch", "parsley (chopped)"), "medium onion (cut)": ("medium", "onion (cut)"), "cloves garlic, crushed": ("cloves", "garlic, crushed"),
        "medium-grain rice": None, "medium grain rice": None, "garlic": None, "large": None, "cloves (2)": None, None: None,
    }
    got = one(spark, list(want), names.split_descriptor(X))
    assert [r and (r.unit, r.name) for r in got] == list(want.values())
    plans = ["large cloves of garlic", "garlic", "medium-grain rice", "medium grain rice", "large or 4 small onions", "large 2 cups onion", "small pot (about", "large (x)"]
    got = one(spark, plans, names.plan_descriptor(X, F.lit("2")))
    assert [r.reason for r in got] == [None, "no-leading-descriptor", "hyphen-compound", "intrinsic", "alternative", "pre-mangled", "pre-mangled", "empty/paren"]
    assert got[0].qty == "2 large cloves"


def test_orders_of_lists(spark):
    from larder.functions import names

    rows = [([1, 2, 3], 3, 1), ([1, 2, 3], 1, None), ([1, 2, 3], 2, 2), ([1, 2, 3], 1, 9)]
    got = run(spark, rows, names.moved_before(X, F.col("i"), F.col("b")), schema="x array<int>, i int, b int")
    assert [r.c0 for r in got] == [[3, 1, 2], [2, 3, 1], [1, 2, 3], [2, 3, 1]]
    got = run(spark, [([2, 1], [1, 2]), ([1, 1], [1, 2]), ([1], [1, 2]), (None, [1])], names.is_permutation(X, F.col("y")), schema="x array<int>, y array<int>")
    assert [r.c0 for r in got] == [True, False, False, False]
    lines_ = [(False, "a"), (True, "S"), (False, "b"), (True, "T"), (False, "c")]
    got = run(spark, [(lines_, s) for s in (None, "", "S", "T", "gone")] + [([(False, "a")], None)], names.removed_place(X, F.col("s")), schema="x array<struct<is_heading:boolean,text:string>>, s string")
    assert [r.c0 for r in got] == [1, 1, 3, 5, 5, 1]
