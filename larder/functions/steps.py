"""Spans of a method line: which amounts scale with the recipe and which never do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.amounts import GLYPHS, NUMBER, UNIT, leading_value

# What guards a number from scaling.
GUARD = r"(?:°\s*[CF]?|degrees?\b|(?:min(?:ute)?s?|h(?:ou)?rs?|sec(?:ond)?s?)\b|inch(?:es)?\b|\"|cm\b|mm\b)"
MARKED = r"\{\{!?[^}]*\}\}"
GUARDED = rf"{NUMBER}\s*(?:to|[-–—])\s*{NUMBER}\s*-?\s*{GUARD}|{NUMBER}\s*[x×]\s*{NUMBER}|{NUMBER}\s*-?\s*{GUARD}"
MEASURED = rf"{NUMBER}\s*(?:to|[-–—])\s*{NUMBER}\s*{UNIT}\b|{NUMBER}\s*{UNIT}\b"
#: Tokens start with a digit, a fraction sign or a marker; each alternative is a group that names its category.
TOKEN = rf"(?iU)(?=[\d{GLYPHS}{{])(?:(\{{\{{![^}}]*\}}\}})|({MARKED})|({GUARDED})|({MEASURED})|({NUMBER}))"
CATEGORIES = ("marked_lock", "marked_scale", "guarded", "heuristic_scale", "unitless")
MAY_HAVE = rf"(?U)[\d{GLYPHS}]|\{{\{{"
#: Two code points that Unicode keeps for a program's own use; texts are read without them.
_END, _NEXT = "\ufdd0", "\ufdd1"
_SPAN = "array<struct<category:string,text:string,value:double,unit:string>>"


def _pieces(text: Column) -> Column:
    """A line cut before each token: arrays of the five groups of a token (one is filled) and what follows it.

    One replacement writes the groups between marks, so that the text is searched once.
    """
    marked = F.regexp_replace(F.translate(text, _END + _NEXT, ""), TOKEN, _END + _NEXT.join(f"${i}" for i in range(1, 6)) + _NEXT)
    return F.transform(F.split(marked, _END, -1), lambda p: F.split(p, _NEXT, -1))


def _category(piece: Column) -> Column:
    return F.get(F.filter(F.array(*(F.when(F.get(piece, i) != "", F.lit(c)) for i, c in enumerate(CATEGORIES))), lambda c: c.isNotNull()), 0)


def tokens(text: Column) -> Column:
    """Array of (category, text) of a line's tokens; markers don't belong to the text."""

    def token(piece: Column) -> Column:
        content = F.regexp_extract(F.concat(F.get(piece, 0), F.get(piece, 1)), r"^\{\{!?([^}]*)\}\}$", 1)
        return F.struct(_category(piece).alias("category"), F.concat(content, *(F.get(piece, i) for i in (2, 3, 4))).alias("text"))

    none = F.array().cast("array<struct<category:string,text:string>>")
    return F.when(text.rlike(MAY_HAVE), F.transform(F.filter(_pieces(text), lambda p: F.size(p) > 1), token)).otherwise(none)


def spans(text: Column) -> Column:
    """Array of (category, text, value, unit) that together are the line, markers aside."""
    none = [F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit")]
    plain = lambda b: F.struct(F.lit("plain").alias("category"), b.alias("text"), *none)

    def told(piece: Column) -> Column:
        content = F.regexp_extract(F.concat(F.get(piece, 0), F.get(piece, 1)), r"^\{\{!?([^}]*)\}\}$", 1)
        words = F.concat(content, *(F.get(piece, i) for i in (2, 3, 4)))
        scales = (F.get(piece, 1) != "") | (F.get(piece, 3) != "")
        read = leading_value(words)
        own = F.struct(_category(piece).alias("category"), words.alias("text"), F.when(scales, read["value"]).alias("value"), F.when(scales, read["unit"]).alias("unit"))
        return F.when(F.size(piece) == 1, F.array(plain(F.get(piece, 0)))).otherwise(F.array(own, plain(F.get(piece, 5))))

    every = F.when(text.rlike(MAY_HAVE), F.flatten(F.transform(_pieces(text), told))).when(text.isNotNull(), F.array(plain(text)))
    return F.filter(every.cast(_SPAN), lambda s: (s["text"] != "") | s["category"].startswith("marked"))


def client_spans(text: Column) -> Column:
    """The spans with neighbouring fixed ones merged: (t, text, value, unit), t being plain or scale."""
    kind = "array<struct<t:string,text:string,value:double,unit:string>>"
    scales = lambda s: s["category"].isin("marked_scale", "heuristic_scale")

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fixed = ~scales(s)
        item = lambda words: F.struct(F.when(fixed, "plain").otherwise("scale").alias("t"), words.alias("text"), s["value"].alias("value"), s["unit"].alias("unit"))
        merge = fixed & (F.size(acc) > 0) & (last["t"] == "plain")
        return F.when(merge, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(item(F.concat(last["text"], s["text"]))))).otherwise(F.concat(acc, F.array(item(s["text"])))).cast(kind)

    return F.aggregate(spans(text), F.array().cast(kind), add)
