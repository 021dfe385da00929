"""Recipe texts with known answers: method lines, ingredient lines and web pages.

The benchmark tables hold no recipes. These views write recipe texts from their numbers, in a few
shapes whose reading the reference's tests and rules fix; for the oracle each shape's answer is a plain
SQL expression of the same numbers, written by hand and not by the code under test. ``n`` is a number
from 1 on.
"""

from __future__ import annotations

_NULL = "NULL"

#: Method lines: the text, then the answers by category (0 where none is named).
METHOD: tuple[tuple[str, dict[str, str]], ...] = (
    ("concat('Bake at ', n * 10, '°F for ', n, ' to ', n + 5, ' minutes.')", {"guarded": "2", "spans": "concat('plain=Bake at ', n * 10, '°F for ', n, ' to ', n + 5, ' minutes.')"}),
    ("concat('Stir in ', n, ' 1/2 cups milk and 1 to 2 tablespoons ice water.')", {"heuristic_scale": "2", "spans": "concat('plain=Stir in |scale=', n, ' 1/2 cups|plain= milk and |scale=1 to 2 tablespoons|plain= ice water.')"}),
    ("concat('Whisk {{', n, ' cups}} oil, then rest {{!', n, ' minutes}}.')", {"marked_scale": "1", "marked_lock": "1", "spans": "concat('plain=Whisk |scale=', n, ' cups|plain= oil, then rest ', n, ' minutes.')"}),
    ("concat('Divide into ', n, ' pieces.')", {"unitless": "1", "unitless_texts": "cast(n AS string)", "spans": "concat('plain=Divide into ', n, ' pieces.')"}),
    ("concat('Press into a 9x13 pan, ', n, ' inches deep.')", {"guarded": "2", "spans": "concat('plain=Press into a 9x13 pan, ', n, ' inches deep.')"}),
    ("'FOR THE CRUST'", {"headings": "1"}),
    ("'Fold gently until smooth.'", {"spans": "'plain=Fold gently until smooth.'"}),
    ("concat('Add ½ cup sugar and ', n, ' eggs -')", {"headings": "1"}),
)

LINE_FIELDS = ("kind", "amount", "value", "unit", "name", "lo", "hi", "grams", "secondary", "flags")


def _line(kind: str, name: str, amount: str = "''", value: str = _NULL, unit: str = "''", lo: str = _NULL, hi: str = _NULL, grams: str = _NULL, secondary: str = _NULL, flags: str = "''") -> dict[str, str]:
    return {"kind": f"'{kind}'", "amount": amount, "value": value, "unit": unit, "name": name, "lo": lo, "hi": hi, "grams": grams, "secondary": secondary, "flags": flags}


_N = "cast(n AS string)"
#: Ingredient lines with what each field of their reading is.
WRITTEN: tuple[tuple[str, dict[str, str]], ...] = (
    ("concat(n, ' cups flour')", _line("ingredient", "'flour'", _N, "n", "'cups'")),
    ("concat(n, ' cup (', n * 10, 'g) dried beans')", _line("ingredient", "'dried beans'", _N, "n", "'cup'", grams="n * 10", secondary="concat(n, ' cup')")),
    ("concat(n, ' g (1 cup) granulated sugar')", _line("ingredient", "'granulated sugar'", _N, "n", "'g'", grams="n", secondary="'1 cup'")),
    ("'SAUCE:'", _line("section", "'SAUCE:'")),
    ("'salt'", _line("flagged", "'salt'", flags="'ambiguous_section'")),
    ("concat(n, ' x 2 cans tomatoes')", _line("flagged", "concat(n, ' x 2 cans tomatoes')", flags="'multiplier'")),
    ("concat(n, ' (400g) cans chickpeas')", _line("ingredient", "'chickpeas'", _N, "n", "'cans'", grams="400")),
    ("concat(n, ' to ', n + 2, ' eggs')", _line("ingredient", "'eggs'", "concat(n, ' to ', n + 2)", lo="n", hi="n + 2")),
    ("concat(n, ' 1/2 tsp vanilla')", _line("ingredient", "'vanilla'", "concat(n, ' 1/2')", "n + 0.5", "'tsp'")),
    ("'crust'", _line("section", "'crust'", flags="'section_suggested'")),
    ("concat(n, ' tablespoons butter each')", _line("flagged", "'butter each'", _N, "n", "'tablespoons'", flags="'each_multi'")),
    ("'**Other Ingredients:**'", _line("section", "'Other Ingredients:'")),
    ("concat(n, ' tbsp extra virgin olive oil')", _line("ingredient", "'extra virgin olive oil'", _N, "n", "'tbsp'")),
    ("concat(n, '.25 tsp salt')", _line("ingredient", "'salt'", "concat(n, '.25')", "n + 0.25", "'tsp'")),
    ("concat(n, ' Garlic Cloves, peeled')", _line("ingredient", "'Garlic Cloves, peeled'", _N, "n")),
    ("'FOR THE PASTRY'", _line("section", "'FOR THE PASTRY'")),
    ("'For the dough'", _line("section", "'For the dough'", flags="'section_suggested'")),
    ("'For serving'", _line("flagged", "'For serving'", flags="'ambiguous_section'")),
    ("'Extra-virgin olive oil'", _line("flagged", "'Extra-virgin olive oil'", flags="'ambiguous_section'")),
    ("concat(n, ' cup flour: sifted')", _line("ingredient", "'flour: sifted'", _N, "n", "'cup'")),
    ("concat(n, ' EGGS')", _line("ingredient", "'EGGS'", _N, "n")),
    ("concat('**Day ', n, '**')", _line("section", "concat('Day ', n)")),
    ("concat('Day ', n)", _line("section", "concat('Day ', n)")),
    ("'Italian Beef Ingredients'", _line("section", "'Italian Beef Ingredients'")),
    ("'Metric'", _line("section", "'Metric'")),
    ("'US Customary'", _line("section", "'US Customary'")),
    ("concat(n, ' pint (about ', n * 320, ' grams) blueberries')", _line("ingredient", "'pint blueberries'", _N, "n", grams="n * 320")),
    ("concat(n, ' teaspoons / 6 g active dry yeast')", _line("ingredient", "'active dry yeast'", _N, "n", "'teaspoons'", secondary="'/ 6 g'")),
    ("concat(n, ' 1/2 cups / ', n * 10, ' g bread flour or high gluten flour')", _line("ingredient", "'bread flour or high gluten flour'", "concat(n, ' 1/2')", "n + 0.5", "'cups'", secondary="concat('/ ', n * 10, ' g')")),
    ("concat(n, ' tbsp Thai tea mix (')", _line("ingredient", "'Thai tea mix'", _N, "n", "'tbsp'")),
    ("concat(n, ' tbsp soy sauce (low sodium)')", _line("ingredient", "'soy sauce (low sodium)'", _N, "n", "'tbsp'")),
    ("concat(n, ' cup plus 2 tablespoons (', n * 100, 'g) tahini (light roast)')", _line("ingredient", "'plus 2 tablespoons tahini (light roast)'", _N, "n", "'cup'", grams="n * 100", secondary="concat(n, ' cup')")),
    ("'1 x 397 grams can of condensed milk'", _line("ingredient", "'condensed milk'", "'1'", "1", "'can'", grams="397")),
    ("concat(n, ' x 6 oz halibut fillets')", _line("flagged", "concat(n, ' x 6 oz halibut fillets')", flags="'multiplier'")),
    ("'Nonstick spray'", _line("flagged", "'Nonstick spray'", flags="'ambiguous_section'")),
    ("'maple syrup for drizzling on top'", _line("flagged", "'maple syrup for drizzling on top'", flags="'ambiguous_section'")),
    ("concat(n, ' egg for egg wash')", _line("ingredient", "'egg for egg wash'", _N, "n")),
    ("'salt*'", _line("flagged", "'salt*'", flags="'ambiguous_section'")),
    ("'use metric measurements'", _line("flagged", "'use metric measurements'", flags="'ambiguous_section'")),
    ("concat(n, ' cup canned pumpkin (not pumpkin pie filling)')", _line("ingredient", "'canned pumpkin (not pumpkin pie filling)'", _N, "n", "'cup'")),
)

#: Quantities: the text, then doubled, in metric units at a density of 0.51, whether it is a volume, and the sum of its parts.
QUANTITY_FIELDS = ("doubled", "metric", "is_volume", "total")
QUANTITIES: tuple[tuple[str, dict[str, str]], ...] = (
    ("concat(n, ' cups')", {"quantity": _N, "unit": "'cups'", "doubled": "concat(CASE WHEN 2 * n >= 20 THEN 2 * n ELSE 2 * n END, ' cups')", "metric": "concat('~', cast(floor(236.588 * n * 0.51 + 0.5) AS bigint), ' g')", "is_volume": "true", "total": "n"}),
    ("concat(n, ' lb')", {"quantity": _N, "unit": "'lb'", "doubled": "concat(2 * n, ' lb')", "metric": "concat(cast(floor(453.592 * n + 0.5) AS bigint), ' g')", "is_volume": "false", "total": "n"}),
    ("concat(n, ' to ', n + 3, ' tbsp')", {"quantity": "concat(n, ' to ', n + 3)", "unit": "'tbsp'", "doubled": "concat(2 * n, ' to ', 2 * n + 6, ' tbsp')", "metric": _NULL, "is_volume": "true", "total": "n"}),
    ("concat(n, ' + 2 tsp')", {"quantity": "concat(n, ' + 2 tsp')", "unit": "''", "doubled": "concat(2 * n, ' + 4 tsp')", "metric": _NULL, "is_volume": "true", "total": "n + 2"}),
    ("'pinch'", {"quantity": "'pinch'", "unit": "''", "doubled": "'pinch'", "metric": _NULL, "is_volume": "false", "total": _NULL}),
    ("concat(n, ' 1/2 cups')", {"quantity": "concat(n, ' 1/2')", "unit": "'cups'", "doubled": "concat(2 * n + 1, ' cups')", "metric": "concat('~', cast(floor(236.588 * (n + 0.5) * 0.51 + 0.5) AS bigint), ' g')", "is_volume": "true", "total": "n + 0.5"}),
)

_BLOCK = '<html><head><script type="application/ld+json">'
_END = "</script></head></html>"
_FIRST = (
    """{"@context":"https://schema.org","@type":"Recipe","name":"Pie &amp; Co ', id % 97, '","author":{"@type":"Person","name":"Ann"},"recipeYield":["4","4 servings"],"recipeCategory":"Dessert, Pie","recipeCuisine":["Pie","French"],"prepTime":"PT1H15M","""
    """"recipeIngredient":["', n, ' cups flour","SAUCE:","salt","', n, ' cup (', n * 10, 'g) dried beans"],"recipeInstructions":[{"@type":"HowToStep","text":"Bake at 350°F for ', n, ' minutes."},{"@type":"HowToSection","name":"Crust","itemListElement":[{"@type":"HowToStep","text":"Roll."}]}]}"""
)
_GRAPH = """{"@graph":[{"@type":"Person","@id":"#a","name":"Bo"},{"@type":["Thing","Recipe"],"name":"Cake ', id % 89, '","author":{"@id":"#a"},"recipeYield":"Serves 6","recipeIngredient":["', n, ' eggs","½ cup sugar"],"recipeInstructions":["Mix.","Serve -"]}]}"""
PAGE_FIELDS = ("refusal", "name", "source", "servings", "prep_time", "category", "n_lines", "n_flagged", "n_steps", "n_headings")


def _page(refusal: str = _NULL, name: str = _NULL, source: str = _NULL, servings: str = _NULL, prep_time: str = _NULL, category: str = _NULL, n_lines: int = 0, n_flagged: int = 0, n_steps: int = 0, n_headings: int = 0) -> dict[str, str]:
    return {"refusal": refusal, "name": name, "source": source, "servings": servings, "prep_time": prep_time, "category": category, "n_lines": str(n_lines), "n_flagged": str(n_flagged), "n_steps": str(n_steps), "n_headings": str(n_headings)}


#: Pages: the HTML, and what is read from it.
PAGES: tuple[tuple[str, dict[str, str]], ...] = (
    (f"concat('{_BLOCK}{_FIRST}{_END}')", _page(name="concat('Pie & Co ', id % 97)", source="'Ann'", servings="4", prep_time="'1 hr 15 min'", category="'Dessert · Pie · French'", n_lines=4, n_flagged=1, n_steps=3, n_headings=1)),
    (f"concat('{_BLOCK}{_GRAPH}{_END}')", _page(name="concat('Cake ', id % 89)", source="'Bo'", servings="6", n_lines=2, n_steps=2, n_headings=1)),
    (f"""'{_BLOCK}{{"@type":["Article","Thing"],"headline":"News"}}{_END}'""", _page("'NOT_A_RECIPE'")),
    (f"""'{_BLOCK}{{"@type":"Recipe","name":"Half"}}{_END}'""", _page("'INCOMPLETE'")),
    (f"'{_BLOCK}{{bad{_END}'", _page("'NO_STRUCTURED_DATA'")),
    ("'<p>none</p>'", _page("'NO_STRUCTURED_DATA'")),
)


def chosen(shape: str, shapes: tuple[tuple[str, dict[str, str]], ...], field: str | None = None, default: str = "0") -> str:
    """The CASE over a shape's number that gives the text, or one field of the answer."""
    of = [text if field is None else answer.get(field, default) for text, answer in shapes]
    return f"CASE {shape} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(of)) + " END"


def answers(name: str, keys: str, shapes: tuple[tuple[str, dict[str, str]], ...], fields: tuple[str, ...], kinds: dict[str, str]) -> str:
    """SELECT of the keys and answers of a view, for DuckDB; ``kinds`` has the types that aren't text."""
    columns = ", ".join(f"CAST({chosen('shape', shapes, f, _NULL)} AS {kinds.get(f, 'VARCHAR')}) AS {f}" for f in fields)
    return f"SELECT {keys}, {columns} FROM {name}"
