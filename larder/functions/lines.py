"""Ingredient and method lines: from text to kinds, amounts, weights and review flags.

Everything is one ladder of Column expressions over one regular-expression engine; a line that can't
be read for certain is flagged, never guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.amounts import GLYPHS, NUMBER, UNIT, parse_amount, plain_fractions, value_of
from larder.functions.text import let, squeeze, strip

# Patterns and word lists by which lines are told apart.
VOLUME_UNIT = r"(?:tablespoons?|teaspoons?|millilit(?:re|er)s?|lit(?:re|er)s?|cups?|tbsp|tsp|ml|l)"
VOLUME_PAREN = rf"(?iU)\(\s*(?:about\s+|~\s*)?({NUMBER}\s*{VOLUME_UNIT})\s*\)"
WEIGHT_UNITS = ("g", "gram", "grams")
VOLUME_UNITS = ("cup", "cups", "tbsp", "tablespoon", "tablespoons", "tsp", "teaspoon", "teaspoons", "ml", "millilitre", "millilitres", "milliliter", "milliliters", "l", "litre", "litres", "liter", "liters")
PAREN, GRAMS = r"\(([^)]*)\)", r"(?iU)(\d+(?:\.\d+)?)\s*g(?:rams?)?\b"
VOLUME_WORDS = r"(?iU)\b(cups?|tbsp|tablespoons?|tsp|teaspoons?|oz|ounces?|ml|fl)\b"
MEASURE = rf"(?:\d+(?:\.\d+)?(?:\s*/\s*\d+)?|\d+\s+\d+/\d+|\d+\s*[{GLYPHS}]|[{GLYPHS}])\s*(?:grams?|g|kilograms?|kg|ounces?|oz|pounds?|lbs?|lb|cups?|tablespoons?|tbsp|teaspoons?|tsp|millilit(?:re|er)s?|ml|lit(?:re|er)s?|l|sticks?)"
HEDGE = r"(?:about|around|approx\.?|approximately|~)"
MEASURE_LIST = rf"(?iU)^\s*{HEDGE}?\s*{MEASURE}(?:(?:\s*[;/,]\s*|\s+or\s+){HEDGE}?\s*{MEASURE})+(?:\s+total)?\s*$"
PREPARED = r"(?iU)\b(minced|chopped|sliced|diced|crushed|peeled|grated|halved|quartered|divided|crumbled|melted|softened|beaten|cubed|julienned|trimmed|drained|rinsed|shredded|seeded|deboned|sifted|packed|room temperature|finely|roughly|thinly)\b"
SERVINGS = r"(?iU)(?:servings|serving|serves|makes?|portions?)\s*:?\s*(\d+)|(\d+)\s*(?:servings?|portions?)\b"
SECTION_WORDS = ("crust", "filling", "topping", "sauce", "dough", "batter", "base", "marinade", "glaze", "frosting", "icing", "streusel", "crumble", "coating", "assembly", "garnish", "dressing", "syrup")
#: More words than a key of a section may have; told at the fourth one, without a key.
OVER_THREE_WORDS = r"^[^a-z0-9]*+(?:[a-z0-9]++[^a-z0-9]++){3}[a-z0-9]"
UNIT_SYSTEMS = ("metric", "imperial", "us", "us customary", "metric units", "imperial units", "us units")
PREPARATIONS = ("egg wash", "dredge", "sponge", "brine")
STEP_VERB = r"(?iU)^(?:to\s+)?(?:make|prepare|assemble|finish|build|cook|for)\s+(?:the\s+)?"
CONTAINER = r"(?:cans?|jars?|packages?|pkgs?|boxes|box|bottles?|tins?|tubs?|containers?|bags?)"
SIZE = r"\d+(?:\.\d+)?\s*-?\s*(?:ounces?|oz|grams?|g|pounds?|lbs?|lb|kilograms?|kg)(?:\s*[./]\s*\d+(?:\.\d+)?\s*(?:grams?|g)\b)?"
SIZE_TOKEN = r"(?iU)(\d+(?:\.\d+)?)\s*-?\s*(ounces?|oz|grams?|g|pounds?|lbs?|lb|kilograms?|kg)\b"
SIZE_GRAMS = {"ounce": 28.35, "ounces": 28.35, "oz": 28.35, "gram": 1.0, "grams": 1.0, "g": 1.0, "pound": 453.592, "pounds": 453.592, "lb": 453.592, "lbs": 453.592, "kilogram": 1000.0, "kilograms": 1000.0, "kg": 1000.0}
#: Four shapes of canned goods, with the groups of count, container, size and the thing.
CANNED = (
    (rf"(?iU)^\s*({NUMBER})\s*[x×]\s*({SIZE})\s+({CONTAINER})\b\s+(?:of\s+)?(\S.*)$", (1, 3, 2, 4)),
    (rf"(?iU)^\s*({NUMBER})\s+({CONTAINER})\s*\(\s*({SIZE})[^)]*\)\s*(?:of\s+)?(\S.*)$", (1, 2, 3, 4)),
    (rf"(?iU)^\s*({NUMBER})\s*\(\s*({SIZE})[^)]*\)\s*({CONTAINER})\b\s*(?:of\s+)?(\S.*)$", (1, 3, 2, 4)),
    (rf"(?iU)^\s*({NUMBER})\s+({SIZE})\s+({CONTAINER})\b\s*(?:of\s+)?(\S.*)$", (1, 3, 2, 4)),
)
REPAIRS = (("cleaned_paren_comma", r"(?U)\(\s*,\s*", "("), ("cleaned_double_paren", r"(?U)\(\s*\(([^()]*)\)\s*\)", "($1)"))
TRAILING_DASH = r"(?U)\s*[-–—]\s*$"
NUMBERED = rf"(?U)^\s*[\d{GLYPHS}]"
SECOND_MEASURE = rf"(?iU)^/\s*{NUMBER}\s*{UNIT}\b\s*"


def repaired(text: Column) -> tuple[Column, Column]:
    """A line without publisher artifacts, and the flags of what was repaired."""
    flags, now = [], text
    for flag, pattern, by in REPAIRS:
        new = F.regexp_replace(now, pattern, by)
        flags.append(F.when(new != now, flag))
        now = new
    return now, F.array_compact(F.array(*flags))


def is_section(text: Column) -> Column:
    """Ends with a colon, or has letters and all are capitals."""
    t = strip(text)
    return (t != "") & (t.endswith(":") | (t.rlike(r"\p{L}") & (t == F.upper(t))))


def without_emphasis(text: Column) -> Column:
    """Without one pair of markers around the whole line."""
    wrap = r"^(\*\*|__|\*|_)(.+?)\1$"
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(wrap), strip(F.regexp_extract(t, wrap, 2))).otherwise(t))


def section_signal(text: Column) -> Column:
    """Whether a line without an amount is surely a heading."""

    def named(bare: Column) -> Column:
        return reduce(lambda a, b: a | b, (bare.endswith(f" {w}") for w in PREPARATIONS), bare.isin(*PREPARATIONS))

    def told(t: Column) -> Column:
        prepared = let(strip(F.regexp_replace(F.lower(t), ":+$", "")), named)
        return is_section(t) | ((t != "") & (t.rlike(r"(?iU)\bingredients?\b") | F.lower(t).isin(*UNIT_SYSTEMS) | t.rlike(r"(?iU)^\W*day\s+\d") | prepared))

    return let(strip(text), told)


def section_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " "))


def section_candidate(line: Column, hints: Column) -> Column:
    """A short line that ends with a section word, or is named like a section of the method."""
    named = lambda key: (key != "") & (F.element_at(F.split(key, " "), -1).isin(*SECTION_WORDS) | F.array_contains(hints, key))
    long = F.coalesce(F.lower(line).rlike(OVER_THREE_WORDS), F.lit(False))
    return F.when(long, False).otherwise(let(section_key(line), named))


def classify_step(text: Column) -> Column:
    """(is_heading, text) of a line of the method; a trailing dash makes a heading and goes."""
    t = strip(F.coalesce(text, F.lit("")))
    dashed = t.rlike(TRAILING_DASH)
    return F.struct((dashed | is_section(t)).alias("is_heading"), F.when(dashed, strip(F.regexp_replace(t, TRAILING_DASH, ""))).otherwise(t).alias("text"))


def step_hints(steps: Column) -> Column:
    """The names of a method's sections, as keys that ingredient headings may mirror."""
    headings = F.filter(steps, lambda s: classify_step(s)["is_heading"])
    return F.filter(F.array_distinct(F.transform(headings, lambda s: section_key(F.regexp_replace(strip(s), STEP_VERB, "")))), lambda k: k != "")


def size_grams(size: Column) -> Column:
    """Grams of a container's size: those written, else converted and rounded half to even."""
    factor = F.create_map(*(F.lit(x) for p in SIZE_GRAMS.items() for x in p))
    unit = lambda t: F.lower(F.regexp_extract(t, SIZE_TOKEN, 2))
    chosen = lambda tokens: F.coalesce(F.get(F.filter(tokens, lambda t: unit(t).isin("g", "gram", "grams")), 0), F.get(tokens, 0))
    grams = lambda t: F.bround(F.regexp_extract(t, SIZE_TOKEN, 1).try_cast("double") * factor[unit(t)])
    return let(F.regexp_extract_all(size, F.lit(SIZE_TOKEN), F.lit(0)), lambda tokens: let(chosen(tokens), grams))


def parse_canned(line: Column) -> Column:
    """(amount, value, unit, name, grams) of counted containers with a size, else null."""

    def shape(pattern: str, groups: tuple[int, int, int, int]) -> Column:
        count, container, size, thing = (F.regexp_extract(line, pattern, g) for g in groups)
        value = let(plain_fractions(count), value_of)
        read = lambda grams: F.when(grams.isNotNull(), F.struct(F.trim(count).alias("amount"), value.alias("value"), F.lower(container).alias("unit"), strip(thing).alias("name"), grams.alias("grams")))
        return F.when(line.rlike(pattern), let(size_grams(size), read))

    return F.coalesce(*(shape(p, g) for p, g in CANNED))


def harvest_grams(text: Column) -> Column:
    """(grams, declined, paren): the weight that a parenthesis states for the whole line.

    A list of measures states one quantity in several ways; else the parenthesis must hold the weight
    alone. Weights beside volumes or other numbers are declined.
    """

    def judged(g: Column, content: Column, values: Column) -> Column:
        listed = content.rlike(MEASURE_LIST)
        others = F.filter(F.regexp_extract_all(content, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n != F.get(values, 0))
        good = F.when(listed, F.size(F.array_distinct(values)) == 1).otherwise(~content.rlike(VOLUME_WORDS) & (F.size(others) == 0))
        return F.when(good, F.struct(F.get(values, 0).try_cast("double").alias("grams"), F.when(~listed, g).alias("paren")))

    def read(g: Column) -> Column:
        return let(F.regexp_extract(g, PAREN, 1), lambda c: let(F.regexp_extract_all(c, F.lit(GRAMS), F.lit(1)), lambda v: judged(g, c, v)))

    def told(groups: Column) -> Column:
        first = F.get(F.filter(F.transform(groups, read), lambda r: r.isNotNull()), 0)
        return let(first, lambda f: F.struct(f["grams"].alias("grams"), (f.isNull() & (F.size(groups) > 0)).alias("declined"), f["paren"].alias("paren")))

    none = F.struct(F.lit(None).cast("double").alias("grams"), F.lit(False).alias("declined"), F.lit(None).cast("string").alias("paren"))
    stated = let(F.filter(F.regexp_extract_all(text, F.lit(PAREN), F.lit(0)), lambda g: g.rlike(GRAMS)), told)
    return F.when(~text.contains("("), none).otherwise(stated)


def parse_servings(raw: Column) -> Column:
    """A bare whole number, or one beside a word for servings; else null."""
    s = strip(raw)
    either = F.coalesce(F.nullif(F.regexp_extract(s, SERVINGS, 1), F.lit("")), F.nullif(F.regexp_extract(s, SERVINGS, 2), F.lit("")))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("int")).otherwise(either.try_cast("int"))


_LINE = "struct<raw:string,kind:string,amount:string,value:double,unit:string,name:string,lo:double,hi:double,grams:double,has_alternative:boolean,has_prep_note:boolean,secondary:string,flags:array<string>,suggestion:string>"


def _measured_name(parsed: Column, paren: Column) -> Column:
    """(name, slash, volume): the name of a measured line without its second measures, and those."""
    slash = F.when(parsed.rlike(SECOND_MEASURE), strip(F.regexp_extract(parsed, SECOND_MEASURE, 0)))
    bare = F.regexp_replace(F.when(slash.isNotNull(), strip(F.regexp_replace(parsed, SECOND_MEASURE, ""))).otherwise(parsed), r"(?U)\s*\($", "")

    def cut(name: Column) -> Column:
        at = F.instr(name, paren)
        return F.when(paren.isNull(), name).when(at > 0, squeeze(F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + F.length(paren), F.length(name))))).otherwise(squeeze(name))

    def told(name: Column) -> Column:
        has = name.rlike(VOLUME_PAREN)
        rest = let(F.split(name, VOLUME_PAREN, 2), lambda p: squeeze(F.concat(F.get(p, 0), F.get(p, 1))))
        return F.struct(F.when(has, rest).otherwise(name).alias("name"), slash.alias("slash"), F.when(has, strip(F.regexp_extract(name, VOLUME_PAREN, 1))).alias("volume"))

    return let(bare, lambda b: let(cut(b), told))


def classify_line(raw: Column, hints: Column | None = None) -> Column:
    """One ingredient line as a structure: kind (ingredient, section or flagged), amount, weights and flags."""
    hints = F.array().cast("array<string>") if hints is None else hints
    none = F.lit(None)
    other = lambda c: c.rlike(r"(?iU)\bor\b")

    def ladder(t: Column, line: Column, harvest: Column) -> Column:
        flags = F.concat(F.when(harvest["declined"], F.array(F.lit("grams_declined"))).otherwise(F.array().cast("array<string>")), t["repairs"])

        def result(kind, name, *, amount=F.lit(""), value=none, unit=F.lit(""), lo=none, hi=none, grams=harvest["grams"], alternative=F.lit(False), prep=F.lit(False), secondary=none, more=None, suggestion=none) -> Column:
            kind = F.lit(kind) if isinstance(kind, str) else kind
            own = flags if more is None else F.array_compact(F.concat(flags, F.array(F.lit(more) if isinstance(more, str) else more)))
            fields = dict(raw=raw, kind=kind, amount=amount, value=value, unit=unit, name=name, lo=lo, hi=hi, grams=grams, has_alternative=alternative, has_prep_note=prep, secondary=secondary, flags=own, suggestion=suggestion)
            return F.struct(*(v.alias(k) for k, v in fields.items())).cast(_LINE)

        def measured(p: Column, m: Column) -> Column:
            unit = F.lower(p["unit"])
            grams = F.coalesce(harvest["grams"], F.when(unit.isin(*WEIGHT_UNITS), p["value"]))
            second = F.coalesce(m["volume"], F.when(grams.isNotNull() & unit.isin(*VOLUME_UNITS), F.trim(F.concat_ws(" ", p["amount"], p["unit"]))), m["slash"])
            each = line.rlike(r"(?iU)\beach\b")
            return result(F.when(each, "flagged").otherwise("ingredient"), m["name"], amount=p["amount"], value=p["value"], unit=p["unit"], lo=p["lo"], hi=p["hi"], grams=grams, alternative=other(m["name"]), prep=m["name"].rlike(PREPARED), secondary=second, more=F.when(each, "each_multi"))

        canned = lambda c: result("ingredient", c["name"], amount=c["amount"], value=c["value"], unit=c["unit"], grams=c["grams"], alternative=other(c["name"]), prep=c["name"].rlike(PREPARED))
        guess = F.when(F.lower(line).rlike("^(for|to) "), "section").otherwise("ingredient")
        without_amount = lambda bare: (
            F.when(section_signal(bare), result("section", bare))
            .when(section_candidate(line, hints), result("section", line, more="section_suggested"))
            .otherwise(result("flagged", line, alternative=other(line), more="ambiguous_section", suggestion=guess))
        )
        with_amount = lambda p: F.when(p["amount"] != "", let(_measured_name(p["name"], harvest["paren"]), lambda m: measured(p, m))).otherwise(let(without_emphasis(line), without_amount))
        numbered = line.rlike(NUMBERED)  # as all three shapes of amounts are
        many = numbered & line.rlike(rf"(?iU)^\s*{NUMBER}\s*[x×]\s*{NUMBER}")
        rest = F.when(many, result("flagged", line, alternative=other(line), more="multiplier")).otherwise(let(F.when(numbered, parse_amount(line)), with_amount))
        return let(F.when(numbered, parse_canned(line)), lambda c: F.when(c.isNotNull(), canned(c)).otherwise(rest))

    def start(line: Column) -> Column:
        # nothing is repaired without a parenthesis
        pair = lambda x, repairs: F.struct(x.alias("line"), repairs.alias("repairs"))
        return F.when(line.contains("("), pair(*repaired(line))).otherwise(pair(line, F.array().cast("array<string>")))

    return let(let(strip(raw), start), lambda t: let(t["line"], lambda x: let(harvest_grams(x), lambda h: ladder(t, x, h))))
