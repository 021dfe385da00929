"""Amounts, units and their scaling as Column expressions.

``(?U)`` makes white space and word ends Unicode-aware. Casts that can fail are tries: what can't be
read is null, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, squeeze, strip

# Fraction signs, number and unit patterns, conversion factors and kitchen fractions.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅙": "1/6", "⅚": "5/6"}
GLYPHS = "".join(FRACTIONS)
JOIN = r"(?:\s+and\s+|\s*[&+]\s*)"
NUMBER = rf"(?:\d+(?:\s+|{JOIN})\d+/\d+|\d+/\d+|\d+(?:\s*|{JOIN})[{GLYPHS}]|[{GLYPHS}]|\d+(?:\.\d+)?)"
RANGE = r"(?:to|[-–—])"
UNITS = (r"fl\s*oz", r"fluid\s+ounces?", "tablespoons?", "teaspoons?", "millilitres?", "milliliters?", "kilograms?", "tbsp", "tsp", "cups?", "litres?", "liters?", "ml", "kg", "grams?", "ounces?", "pounds?", "lbs?", "oz", "lb", "g")
UNIT = f"(?:{'|'.join(UNITS)})"
ABBREVIATIONS = ((r"\bfluid\s+ounces?\b", "fl oz"), (r"\btablespoons?\b", "tbsp"), (r"\bteaspoons?\b", "tsp"), (r"\bkilograms?\b", "kg"), (r"\bmilli(?:lit(?:re|er)s?)\b", "ml"), (r"\blit(?:re|er)s?\b", "liter"), (r"\bounces?\b", "oz"), (r"\bpounds?\b", "lb"), (r"\bgrams?\b", "g"))
VOLUME_ML = {"cup": 236.588, "cups": 236.588, "tablespoon": 14.7868, "tablespoons": 14.7868, "tbsp": 14.7868, "teaspoon": 4.92892, "teaspoons": 4.92892, "tsp": 4.92892}
WEIGHT_G = {"oz": 28.3495, "ounce": 28.3495, "ounces": 28.3495, "lb": 453.592, "lbs": 453.592, "pound": 453.592, "pounds": 453.592}
KITCHEN = ((0.0, ""), (1 / 8, "⅛"), (1 / 6, "⅙"), (1 / 4, "¼"), (1 / 3, "⅓"), (3 / 8, "⅜"), (1 / 2, "½"), (5 / 8, "⅝"), (2 / 3, "⅔"), (3 / 4, "¾"), (5 / 6, "⅚"), (7 / 8, "⅞"), (1.0, ""))
COUNT_NOUN = r"^[A-Za-z][A-Za-z .\-]*$"
LEAD = rf"(?iU)^\s*({NUMBER}(?:\s*{RANGE}\s*{NUMBER})?)(?:\s*({UNIT})\b)?\s*(.*)$"
TOKEN = rf"(?iU){NUMBER}"
TWO_SPOONS_ML = 29.5736


def plain_fractions(c: Column) -> Column:
    """Fraction signs as `` n/d ``, white space squeezed."""
    return squeeze(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(f" {p[1]} ")), FRACTIONS.items(), c))


def glyph_fractions(c: Column) -> Column:
    """ASCII fractions as signs where there is one; a whole number stands right before its fraction."""

    def one(x: Column, pair: tuple[str, str]) -> Column:
        sign, plain = pair
        n = plain.replace("/", "/")
        x = F.regexp_replace(x, rf"(\d)\s+{n}(?!\d)", rf"$1{sign}")
        return F.regexp_replace(x, rf"(?<![\d/]){n}(?!\d)", sign)

    return reduce(one, FRACTIONS.items(), c)


def canonical_amount(c: Column) -> Column:
    """``1 and 1/2`` as ``1 1/2``."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U){JOIN}", " "))


def value_of(c: Column) -> Column:
    """The number of ``2``, ``2.5``, ``1/2`` or ``1 1/2``; null for anything else and for a zero denominator."""
    mixed, part = r"^(?:(\d+)\s+)?(\d+)/(\d+)$", lambda i: F.regexp_extract(c, r"^(?:(\d+)\s+)?(\d+)/(\d+)$", i).try_cast("double")
    fraction = F.coalesce(part(1), F.lit(0.0)) + F.try_divide(part(2), part(3))
    return F.when(c.rlike(mixed), fraction).when(c.rlike(r"^\d+(\.\d+)?$"), c.try_cast("double"))


def parse_amount(line: Column) -> Column:
    """(amount, value, unit, name, lo, hi) of a line's leading amount; a range has no value but bounds."""
    found = line.rlike(LEAD)
    amount = F.when(found, canonical_amount(F.regexp_extract(line, LEAD, 1))).otherwise("")
    unit = F.when(found, F.trim(F.regexp_extract(line, LEAD, 2))).otherwise("")
    name = F.when(found, strip(F.regexp_extract(line, LEAD, 3))).otherwise(strip(line))
    split = F.struct(amount.alias("amount"), unit.alias("unit"), name.alias("name"))

    def read(p: Column) -> Column:
        ranged = p["amount"].rlike(r"(?iU)\d\s*(?:to|[-–—])\s*\d")
        ends = F.split(p["amount"], rf"(?iU)\s*{RANGE}\s*", 2)
        end = lambda i: F.when(ranged, value_of(plain_fractions(F.element_at(ends, i))))
        values = F.struct(F.when(~ranged & (p["amount"] != ""), value_of(plain_fractions(p["amount"]))).alias("value"), end(1).alias("lo"), end(2).alias("hi"))

        def told(v: Column) -> Column:
            both = v["lo"].isNotNull() & v["hi"].isNotNull()
            return F.struct(p["amount"].alias("amount"), v["value"].alias("value"), p["unit"].alias("unit"), p["name"].alias("name"), F.when(both, v["lo"]).alias("lo"), F.when(both, v["hi"]).alias("hi"))

        return let(values, told)

    return let(split, read)


def split_quantity(qty: Column) -> Column:
    """(quantity, unit) of a free-text amount; together they are always the text they came from."""
    pair = lambda q, u: F.struct(q.alias("quantity"), u.alias("unit"))

    def parts(s: Column, p: Column) -> Column:
        whole = pair(s, F.lit(""))
        counted = (p["unit"] == "") & p["name"].rlike(COUNT_NOUN)
        return F.when(p["amount"] == "", whole).when(p["name"] == "", pair(p["amount"], p["unit"])).when(counted, pair(p["amount"], p["name"])).otherwise(whole)

    def checked(s: Column, r: Column) -> Column:
        same = squeeze(F.concat_ws(" ", r["quantity"], r["unit"])) == squeeze(s)
        return F.when(same, r).otherwise(pair(s, F.lit("")))

    return let(strip(F.coalesce(qty, F.lit(""))), lambda s: let(parse_amount(s), lambda p: let(parts(s, p), lambda r: checked(s, r))))


def quantity_text(amount: Column, unit: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", amount, unit)), F.lit(""))


def row_parts(qty: Column, quantity: Column, unit: Column) -> Column:
    """Explicit parts win and make the text anew, else the text is split."""
    given = quantity.isNotNull() | unit.isNotNull()
    q, u = F.coalesce(quantity, F.lit("")), F.coalesce(unit, F.lit(""))
    kept = lambda own: F.struct(qty.alias("qty"), own["quantity"].alias("quantity"), own["unit"].alias("unit"))
    return F.when(given, F.struct(quantity_text(q, u).alias("qty"), q.alias("quantity"), u.alias("unit"))).otherwise(let(split_quantity(qty), kept))


def leading_value(text: Column) -> Column:
    """(value, unit): the first number and what follows it; without a number the whole is the unit."""
    pattern = r"(?s)^\s*(\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)\s*(.*)$"
    pair = lambda v, u: F.struct(v.alias("value"), u.alias("unit"))
    read = lambda t: F.when(t.rlike(pattern), pair(let(F.regexp_extract(t, pattern, 1), value_of), F.trim(F.regexp_extract(t, pattern, 2)))).otherwise(pair(F.lit(None).cast("double"), strip(text)))
    return let(plain_fractions(text), read)


def reference_ml(text: Column) -> Column:
    """Millilitres of ``2 1/4 teaspoons``; null for other units."""
    t = strip(F.lower(text))
    per = F.create_map(*(F.lit(x) for p in VOLUME_ML.items() for x in p))
    return value_of(squeeze(F.regexp_extract(t, r"^(.*) (\S+)$", 1))) * per[F.regexp_extract(t, r"^(.*) (\S+)$", 2)]


def has_volume_unit(qty: Column) -> Column:
    before = rf"(?<![\p{{L}}\p{{N}}_{GLYPHS}])"
    return F.coalesce(qty.rlike(rf"(?iU){before}(fl\s+oz|fluid\s+ounces?|cups?|tbsp|tablespoons?|tsp|teaspoons?|millilit(?:re|er)s?)\b"), F.lit(False))


def short_units(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, f"(?iU){p[0]}", p[1]), ABBREVIATIONS, F.coalesce(c, F.lit("")))


def canonical_units(c: Column) -> Column:
    """The form in which amounts are compared."""
    return F.lower(strip(short_units(c)))


def format_amount(x: Column) -> Column:
    """A number as cooks write it: whole from 20 on, else the nearest kitchen fraction, ``~`` if that is off."""
    rest = x - F.floor(x)
    near = F.array_min(F.array(*(F.struct(F.abs(rest - f).alias("off"), F.lit(i).alias("i"), F.lit(sign).alias("sign"), F.lit(f == 1.0).cast("int").alias("up")) for i, (f, sign) in enumerate(KITCHEN))))

    def told(n: Column) -> Column:
        whole = F.floor(x) + n["up"]
        text = F.when((whole == 0) & (n["sign"] != ""), n["sign"]).otherwise(F.concat(whole.cast("string"), n["sign"]))
        return F.concat(F.when(n["off"] > 0.02, "~").otherwise(""), text)

    return F.when(x >= 20, F.format_number(F.floor(x + 0.5), 0)).otherwise(let(near, told))


def collapse_range(c: Column) -> Column:
    """``1 to 1`` as ``1``."""
    return F.regexp_replace(c, r"(?iU)(?<![\w./])([\d./]*[\d" + GLYPHS + r"])\s*(?:to|[-–—])\s*\1(?![\w./])", "$1")


def scale(qty: Column, factor: Column) -> Column:
    """Every amount in a text times the factor. Texts without amounts, and factors that aren't positive, change nothing."""
    tokens = F.regexp_extract_all(qty, F.lit(TOKEN), F.lit(0))
    between = F.split(qty, TOKEN, -1)
    number = lambda t: let(plain_fractions(canonical_amount(t)), value_of)
    scaled = F.transform(tokens, lambda t: F.coalesce(let(number(t) * factor, format_amount), t))
    joined = F.array_join(F.zip_with(between, F.concat(scaled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return collapse_range(F.when((factor > 0) & (factor != 1), joined).otherwise(qty))


def scale_count(qty: Column, factor: Column) -> Column:
    """A count of things: rounded half up, never under one, ``~`` where the true value is."""
    pattern = rf"(?iU)^\s*({NUMBER})(.*)$"
    true = let(plain_fractions(F.regexp_extract(qty, pattern, 1)), value_of) * factor
    return let(true, lambda x: F.concat(F.when(x < 1, "~").otherwise(""), F.greatest(F.lit(1), F.floor(x + 0.5)).cast("string"), F.regexp_extract(qty, pattern, 2)))


def is_count(qty: Column) -> Column:
    return let(parse_amount(qty), lambda p: (p["amount"] != "") & (p["unit"] == ""))


def summed(qty: Column) -> Column:
    """(value, unit) of ``3 + 2 tbsp``; null value where the parts have different units or can't be read."""

    def told(read: Column) -> Column:
        units = F.array_distinct(F.filter(F.transform(read, lambda r: canonical_units(r["unit"])), lambda u: u != ""))
        total = F.aggregate(read, F.lit(0.0), lambda a, r: a + r["value"])
        return let(units, lambda u: F.struct(F.when(F.size(u) <= 1, total).alias("value"), F.when(F.size(u) == 1, F.get(u, 0)).alias("unit")))

    return let(F.transform(F.split(qty, r"\s*\+\s*"), leading_value), told)


def to_metric(qty: Column, density: Column) -> Column:
    """Grams for ounces and pounds, and for more than two spoons where the density is known; else null."""

    def told(p: Column) -> Column:
        unit = F.lower(p["unit"])
        grams = F.create_map(*(F.lit(x) for q in WEIGHT_G.items() for x in q))[unit]
        ml = F.create_map(*(F.lit(x) for q in VOLUME_ML.items() for x in q))[unit] * p["value"]
        heavy = F.concat(F.floor(p["value"] * grams + 0.5).cast("string"), F.lit(" g"))
        return F.when(grams.isNotNull(), heavy).when((ml > TWO_SPOONS_ML + 1e-6) & density.isNotNull(), F.concat(F.lit("~"), F.floor(ml * density + 0.5).cast("string"), F.lit(" g")))

    return let(parse_amount(qty), told)


def _applied(factor: Column) -> Column:
    """A factor that isn't positive changes nothing."""
    return F.when(factor > 0, factor).otherwise(1.0)


def amount_text(qty: Column, factor: Column) -> Column:
    """an amount as a ledger shows it: counts whole, measures scaled with short units, fractions as signs; blank without one."""
    f, dual = _applied(factor), qty.contains(" / ")
    scaled = let(scale(qty, f), lambda x: F.when(dual, x).otherwise(short_units(x)))
    told = F.when(is_count(qty) & ~dual, F.when(f == 1, qty).otherwise(scale_count(qty, f))).otherwise(scaled)
    return F.when(F.coalesce(strip(qty), F.lit("")) == "", "").otherwise(glyph_fractions(told))


def weight_text(qty: Column, density: Column, factor: Column) -> Column:
    """the estimated grams of a volume beyond two spoons whose density is known; else blank."""
    ml = F.create_map(*(F.lit(x) for q in VOLUME_ML.items() for x in q))

    def told(p: Column) -> Column:
        volume = p["value"] * _applied(factor) * ml[p["unit"]]
        grams = F.format_number(F.greatest(F.lit(1), F.floor(volume * density + 0.5)), 0)
        return F.coalesce(F.when(volume > TWO_SPOONS_ML + 1e-9, F.concat(F.lit("~"), grams, F.lit(" g"))), F.lit(""))

    return let(summed(plain_fractions(qty)), told)
