"""Recipes in web pages: JSON-LD blocks to one record, or a code that says why there is none.

Blocks nest without bound and refer to each other, which no expression can follow; a pandas UDF reads
each page and returns the finished structure.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from larder.functions.shipping import ship

ship(__name__)

BLOCK = re.compile(r"<script[^>]*\btype=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)
ISO = re.compile(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:[\d.]+S)?)?\Z", re.I)
FIELDS = ("name", "servings_raw", "source", "description", "prep_time", "cook_time", "total_time")
LISTS = ("context", "ingredient_lines", "directions", "categories")
SCHEMA = StructType([StructField(n, ArrayType(StringType()) if n in LISTS else StringType()) for n in ("refusal", *FIELDS, *LISTS)])


def clean(value: Any) -> str:
    """Tags go before entities are read, so that written-out tags stay visible."""
    return "" if value is None else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", str(value))).split())


def listed(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def nodes(value: Any) -> Iterator[dict]:
    """Every object at any depth, parents first; long chains don't recurse."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            yield at
            at = list(at.values())
        if isinstance(at, list):
            waiting.extend(reversed(at))


def kinds(node: dict) -> list[str]:
    return [k for k in listed(node.get("@type")) if isinstance(k, str)]


def duration(value: Any) -> str:
    if isinstance(value, dict):
        value = value.get("maxValue") or value.get("value")
    found = ISO.fullmatch(value.strip()) if isinstance(value, str) else None
    minutes = sum(int(n or 0) * m for n, m in zip(found.groups(), (10080, 1440, 60, 1), strict=True)) if found else 0
    return " ".join(f"{n} {unit}" for n, unit in ((minutes // 60, "hr"), (minutes % 60, "min")) if n)


def method(value: Any) -> Iterator[str]:
    """Lines of the method; a section's name is a line with a colon before its steps."""
    for node in value.split("\n") if isinstance(value, str) else listed(value):
        if isinstance(node, dict) and "HowToSection" in kinds(node):
            name = clean(node.get("name"))
            if name:
                yield name if name.endswith(":") else f"{name}:"
            yield from method(node.get("itemListElement") if isinstance(node.get("itemListElement"), list) else [])
        elif line := clean(node.get("text") or node.get("name")) if isinstance(node, dict) else clean(node) if isinstance(node, str) else "":
            yield line


def terms(value: Any) -> list[str]:
    names = [(v.get("name") if isinstance(v, dict) else v) for v in listed(value)]
    return [t for n in names for t in map(clean, str(n or "").split(",")) if t]


def read_page(page: str | None) -> dict:
    """The record's fields, or ``refusal`` (NO_STRUCTURED_DATA, NOT_A_RECIPE, INCOMPLETE) with its ``context``."""
    parsed = []
    for body in BLOCK.findall(page or ""):
        try:
            parsed.append(json.loads(body.strip(), strict=False))
        except ValueError:
            continue
    if not parsed:
        return {"refusal": "NO_STRUCTURED_DATA"}
    every = list(nodes(parsed))
    recipe = next((n for n in every if "Recipe" in kinds(n)), None)
    if recipe is None:
        return {"refusal": "NOT_A_RECIPE", "context": sorted({k for n in every for k in kinds(n)})}
    author = next(iter(listed(recipe.get("author"))), None)
    if isinstance(author, dict) and not author.get("name"):
        # of the nodes with one id the first that has a name speaks
        author = next((n for n in every if n.get("@id") == author.get("@id") and n.get("name") and isinstance(n.get("@id"), str)), None)
    servings = next(iter(listed(recipe.get("recipeYield"))), "")
    servings = servings.get("value") if isinstance(servings, dict) else servings
    out = {
        "name": clean(recipe.get("name")),
        "servings_raw": clean(servings),
        "source": clean(author.get("name") if isinstance(author, dict) else author if isinstance(author, str) else None),
        "description": clean(recipe.get("description")),
        **{f"{t}_time": duration(recipe.get(f"{t}Time")) for t in ("prep", "cook", "total")},
        "ingredient_lines": [t for t in map(clean, listed(recipe.get("recipeIngredient"))) if t],
        "directions": list(method(recipe.get("recipeInstructions"))),
        "categories": list(dict.fromkeys(terms(recipe.get("recipeCategory")) + terms(recipe.get("recipeCuisine")))),
    }
    missing = [what for key, what in (("name", "a name"), ("ingredient_lines", "ingredients"), ("directions", "steps")) if not out[key]]
    return {"refusal": "INCOMPLETE", "context": missing} if missing else out


@F.pandas_udf(SCHEMA)
def page_record(pages: pd.Series) -> pd.DataFrame:
    rows = [read_page(p) for p in pages]
    return pd.DataFrame({n: [r.get(n) for r in rows] for n in SCHEMA.names})


# read once: not merged into the filters and columns that name it
page_record = page_record.asNondeterministic()
