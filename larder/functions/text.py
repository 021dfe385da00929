"""Text as Column expressions: white space, slugs, links, quotes, truncation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larder.functions.shipping import ship

ship(__name__)

LINK = r"\[\[([^\]|]+)\|([^\]]+)\]\]"
#: Unicode's white space: what ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def slug(name: Column) -> Column:
    """A readable id: small letters of any script and digits, joined by hyphens."""
    kept = F.regexp_replace(strip(F.lower(name)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), r"-+", "-"), r"^-|-$", "")


@F.pandas_udf(StringType())
def ascii_folded(names: pd.Series) -> pd.Series:
    """Letters without accents; what has no ASCII form goes. Unicode decomposition has no built-in."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def slug_base(name: Column) -> Column:
    """The ASCII slug that imports start from; ``recipe`` when nothing is left."""
    folded = F.lower(ascii_folded(F.coalesce(name, F.lit(""))))
    joined = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("recipe"))


def links(text: Column) -> Column:
    """Array of (id, label) of the [[id|label]] links in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("id"), F.regexp_extract(m, LINK, 2).alias("label")))


def unquoted(c: Column) -> Column:
    """Stripped, and without one pair of quotes around the whole."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r'(?s)^".*"$') & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def filled_lines(c: Column) -> Column:
    """The stripped lines of a text that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")


def shortened(c: Column, n: int = 66) -> Column:
    t = squeeze(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def caption(c: Column) -> Column:
    """Stripped, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def joined_tags(c: Column) -> Column:
    """Tags as one text; null without any."""
    return F.nullif(F.array_join(F.filter(F.transform(c, lambda t: F.trim(t)), lambda x: x != ""), " · "), F.lit(""))


def split_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "·"), strip), lambda x: x != "")


def plain_html(c: Column) -> Column:
    """Tags go before entities are read, then white space is folded."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return squeeze(bare)


#: A link of a step: an id, and a label if it isn't the name itself.
STEP_LINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
_PART = "struct<text:string,id:string,label:string>"


def step_parts(step: Column) -> Column:
    """the lines of a step, each an array of (text, id, label): stretches of text and links, in order and none of them empty.

    Nothing is lost: :func:`from_step_parts` gives the step back sign by sign. What only looks like a link
    (no id, an empty label) is text. A null step is null.
    """

    def parts(line: Column) -> Column:
        link = lambda m: F.struct(F.lit(None).cast("string").alias("text"), F.regexp_extract(m, STEP_LINK, 1).alias("id"), F.nullif(F.regexp_extract(m, STEP_LINK, 2), F.lit("")).alias("label")).cast(_PART)
        plain = lambda t: F.struct(t.alias("text"), F.lit(None).alias("id"), F.lit(None).alias("label")).cast(_PART)
        between, links_ = F.split(line, STEP_LINK, -1), F.regexp_extract_all(line, F.lit(STEP_LINK), F.lit(0))
        both = F.zip_with(between, links_, lambda t, m: F.array(plain(t), F.when(m.isNotNull(), link(m))))
        return F.filter(F.flatten(both), lambda p: p["id"].isNotNull() | (p["text"] != ""))

    return F.transform(F.split(step, "\n", -1), parts)


def from_step_parts(lines: Column) -> Column:
    """The step that :func:`step_parts` came from."""
    link = lambda p: F.concat(F.lit("[["), p["id"], F.coalesce(F.concat(F.lit("|"), p["label"]), F.lit("")), F.lit("]]"))
    line = lambda parts: F.array_join(F.transform(parts, lambda p: F.when(p["id"].isNotNull(), link(p)).otherwise(F.coalesce(p["text"], F.lit("")))), "")
    return F.array_join(F.transform(lines, line), "\n")
