"""Leading size and count words of ingredient names, and where a list's rows belong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, squeeze, strip

# Words of size and count that may lead a name.
SIZES = ("large", "medium", "small")
COUNTS = ("cloves", "clove", "sprigs", "sprig", "stalks", "stalk", "bunches", "bunch", "cans", "can", "slices", "slice", "heads", "head", "pieces", "piece", "knobs", "knob", "handfuls", "handful", "pinch")
_LEAD = "|".join(sorted(SIZES + COUNTS, key=len, reverse=True))
LEADS = rf"(?iU)^({_LEAD})\b"
PHRASE = rf"(?iU)^((?:{'|'.join(SIZES)})\s+(?:{'|'.join(COUNTS)})|(?:{_LEAD}))\b[ \t]*(?:of\b[ \t]*)?(.*)$"
COMPOUND = rf"(?iU)^(?:{_LEAD})-"
INTRINSIC = r"(?iU)^(?:large|medium|small)[\s-]+(?:grain|dice|curd|batch)\b"
SECOND_QUANTITY = r"(?iU)\b\d[\d./\s-]*(?:teaspoons?|tablespoons?|cups?)\b"
CUT_OFF = r"(?iU)\(\s*about\s*$|\(\s*$"


def split_descriptor(name: Column) -> Column:
    """(unit, name) of ``large cloves of garlic``; null where nothing can be split off for certain."""
    able = lambda n: n.rlike(LEADS) & ~n.rlike(COMPOUND) & ~n.rlike(INTRINSIC)
    rest = lambda n: strip(F.regexp_extract(n, PHRASE, 2))
    pair = lambda n: F.struct(F.lower(squeeze(F.regexp_extract(n, PHRASE, 1))).alias("unit"), rest(n).alias("name"))
    return let(strip(F.coalesce(name, F.lit(""))), lambda n: F.when(able(n), let(pair(n), lambda p: F.when((p["name"] != "") & ~p["name"].startswith("("), p))))


def plan_descriptor(name: Column, quantity: Column) -> Column:
    """(action, reason, unit, name, qty): what a backfill does with a row, and why it leaves one alone."""

    def planned(n: Column, s: Column) -> Column:
        mangled = F.regexp_replace(n, r"\([^)]*\)", "").rlike(SECOND_QUANTITY) | n.rlike(CUT_OFF)
        declined = F.when(n.rlike(COMPOUND), "hyphen-compound").when(n.rlike(INTRINSIC), "intrinsic").otherwise("empty/paren")
        reason = F.when(~n.rlike(LEADS), "no-leading-descriptor").when(mangled, "pre-mangled").when(s.isNull(), declined).when(s["name"].rlike(r"(?iU)^or\b"), "alternative")
        done = lambda r: F.struct(F.when(r["why"].isNull(), "auto").otherwise("skip").alias("action"), r["why"].alias("reason"), F.when(r["why"].isNull(), s["unit"]).alias("unit"), F.when(r["why"].isNull(), s["name"]).alias("name"), F.when(r["why"].isNull(), strip(F.concat_ws(" ", strip(F.coalesce(quantity, F.lit(""))), s["unit"]))).alias("qty"))
        return let(F.struct(reason.alias("why")), done)

    return let(strip(F.coalesce(name, F.lit(""))), lambda n: let(split_descriptor(n), lambda s: planned(n, s)))


def moved_before(order: Column, item: Column, before: Column) -> Column:
    """A list with one item moved before another; at the end without one, unchanged onto itself."""
    rest = F.array_remove(order, item)
    return F.when(item == before, order).otherwise(let(F.struct(rest.alias("r"), F.coalesce(F.array_position(rest, before), F.lit(0)).cast("int").alias("at")), lambda x: F.when(x["at"] > 0, F.array_insert(x["r"], x["at"], item)).otherwise(F.array_append(x["r"], item))))


def is_permutation(order: Column, items: Column) -> Column:
    """Whether a given order names every item once and nothing else."""
    return F.coalesce(F.array_sort(order) == F.array_sort(items), F.lit(False))


def removed_place(rows: Column, section: Column) -> Column:
    """Index at which a removed row shows: the end of its section, before the first heading without one, else the end."""
    headings = F.transform(rows, lambda r, i: F.struct(i.alias("i"), r["is_heading"].alias("h"), r["text"].alias("t")))
    heads = F.filter(headings, lambda r: r["h"])
    first = lambda xs: F.get(xs, 0)["i"]
    own = first(F.filter(heads, lambda r: r["t"] == section))
    blank = F.coalesce(section, F.lit("")) == ""
    after = first(F.filter(heads, lambda r: r["i"] > own))
    return F.coalesce(F.when(blank, first(heads)).when(own.isNotNull(), after), F.size(rows))
