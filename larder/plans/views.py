"""The kitchen's tables, derived from the benchmark tables.

Each view is one projection of one table. Its expressions are plain SQL that Spark and DuckDB both
read, so that a view means the same on either side; the queries on top are written separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.plans.shapes import METHOD, PAGES, QUANTITIES, WRITTEN, chosen
from larder.sources.catalog import table

#: Recipes that events point at, and the moment for which windows of time are asked.
RECIPES, NOW, ME = 400, "2024-01-31 00:00:00", 7
_TEXT_TS = "substring(cast(ts AS string), 1, 19)"
_DAY = "substring(cast(ts AS string), 1, 10)"
_RECIPE = f"event_id * 7 % {RECIPES}"

VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "users": ("customer", {"id": "c_custkey", "display_name": "c_name", "email": "concat(' ', upper(c_name), '@Example.org ')", "is_admin": "c_custkey % 50 = 0"}, "true"),
    "recipes": (
        "orders",
        {
            "id": "o_orderkey",
            "name": "concat(o_orderpriority, '-', cast(o_orderkey % 97 AS string))",
            "owner": "nullif(o_custkey % 150, 0)",
            "category": "o_orderpriority",
            "source": "CASE o_orderstatus WHEN 'F' THEN 'app' WHEN 'O' THEN 'seed' ELSE 'test' END",
            "created_at": "substring(cast(o_orderdate AS string), 1, 19)",
            "image": "CASE WHEN o_orderkey % 3 = 0 THEN concat('img/', cast(o_orderkey % 40 AS string)) END",
            "servings": "CASE o_orderkey % 5 WHEN 0 THEN '4' WHEN 1 THEN 'Serves 6' WHEN 2 THEN '' WHEN 3 THEN 'one 9x13 pan' ELSE '12 servings' END",
            "author": "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('Cook ', cast(o_custkey % 40 AS string)) END",
            "uid": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('u', cast(o_orderkey % 9000 AS string)) END",
        },
        "true",
    ),
    "ingredients": ("part", {"id": "p_partkey", "name": "p_name", "kind": "p_type"}, "true"),
    "lines": (
        "lineitem",
        {
            "recipe_id": "l_orderkey",
            "position": "l_linenumber",
            "is_heading": "CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END",
            "ingredient_id": "CASE WHEN l_linenumber = 1 OR l_partkey % 4 = 0 THEN NULL ELSE l_partkey END",
            "raw_text": "concat(l_returnflag, l_linestatus, ' ', cast(l_suppkey AS string))",
            "label": "CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN l_returnflag END",
            "amount": "cast(l_quantity AS bigint)",
            "qty": "concat(cast(cast(l_quantity AS bigint) AS string), CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN ' cups' WHEN 2 THEN ' 1/2 tsp' ELSE ' cloves' END)",
            "tiebreak": "concat_ws('/', cast(l_partkey AS string), cast(l_suppkey AS string), cast(l_quantity AS string), cast(l_extendedprice AS string))",
            "month": "month(l_shipdate)",
            "supplier": "l_suppkey",
        },
        "true",
    ),
    "cook_log": ("events", {"id": "event_id", "recipe_id": _RECIPE, "user_id": "user_id", "cooked_on": _DAY, "source": "CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'import' END"}, "event_type = 'purchase'"),
    "rating_log": ("events", {"id": "event_id", "recipe_id": _RECIPE, "user_id": "user_id", "rating": "1 + event_id % 6", "rated_on": _DAY}, "event_type = 'view'"),
    "queue_log": ("events", {"id": "event_id", "recipe_id": _RECIPE, "user_id": "user_id", "added_at": _TEXT_TS}, "event_type = 'click'"),
    "friend_log": ("events", {"id": "event_id", "requester": "user_id", "addressee": "event_id * 37 % 150", "status": "CASE WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'pending' END", "created_at": _TEXT_TS}, "event_type = 'signup' AND user_id <> event_id * 37 % 150"),
    "posts": (
        "events",
        {"id": "event_id", "user_id": "user_id", "cook_log_id": "CASE WHEN event_id % 2 = 0 THEN event_id + 1 END", "recipe_id": f"CASE WHEN event_id % 2 = 1 THEN {_RECIPE} END", "caption": "CASE WHEN event_id % 4 = 0 THEN '  ' ELSE concat(' post ', cast(event_id AS string), ' ') END", "created_at": _TEXT_TS},
        "event_type = 'error'",
    ),
    "comments": ("conversations", {"conv_id": "conv_id", "turn": "turn", "author_id": "conv_id * 13 % 150", "body": "substring(text, 1, 40)"}, "true"),
    "turns": ("conversations", {"conv_id": "conv_id", "turn": "turn", "author_id": "conv_id * 13 % 150", "body": "text"}, "true"),
    "photos": (
        "events",
        {"id": "event_id", "recipe_id": _RECIPE, "user_id": "user_id", "cook_log_id": "CASE WHEN event_id % 3 > 0 THEN event_id - event_id % 5 END", "path": "concat('img/', cast(event_id % 40 AS string))", "added_at": _TEXT_TS, "position": "CASE WHEN event_id % 4 < 2 THEN event_id % 7 END"},
        "value > 20",
    ),
    "flags": ("lineitem", {"recipe_id": "l_orderkey", "position": "l_linenumber", "flag": "CASE l_suppkey % 3 WHEN 0 THEN 'ambiguous_section' WHEN 1 THEN 'multiplier' ELSE 'each_multi' END", "reason": "CASE WHEN l_partkey % 2 = 0 THEN 'suggest section' ELSE 'review' END"}, "l_partkey % 10 = 0"),
    "sources": ("pages", {"id": "page_id", "url": "url"}, "true"),
    "replies": ("events", {"id": "event_id", "post_id": "event_id - event_id % 3", "author_id": "user_id"}, "event_type <> 'error'"),
    "snapshot_log": ("events", {"id": "event_id", "recipe_id": "event_id * 3 % 1500", "cook_log_id": "CASE WHEN event_id % 2 = 0 THEN event_id - event_id % 4 END"}, "event_type IN ('click', 'signup')"),
}


_QUANTITY = "cast(l_quantity AS bigint)"
_KEYS = {"recipe_id": "l_orderkey", "position": "l_linenumber", "n": _QUANTITY}
VIEWS |= {
    "method": ("lineitem", {**_KEYS, "shape": f"(l_linenumber + l_orderkey) % {len(METHOD)}"}, "true"),
    "written": ("lineitem", {**_KEYS, "shape": f"(l_linenumber + l_partkey) % {len(WRITTEN)}"}, "true"),
    "quantities": ("lineitem", {**_KEYS, "shape": f"(l_linenumber + l_suppkey) % {len(QUANTITIES)}"}, "true"),
    "recipe_pages": ("orders", {"id": "o_orderkey", "n": "1 + o_custkey % 9", "shape": f"o_orderkey % {len(PAGES)}", "url": "concat('https://www.site', o_custkey % 50, '.example/r/', o_orderkey % 5000, '?utm_source=x')"}, "true"),
}
#: What these views write from their columns, as ``text``.
WRITES = {"method": METHOD, "written": WRITTEN, "quantities": QUANTITIES, "recipe_pages": PAGES}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns, where = VIEWS[name]
    rows = table(spark, folder, source).where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
    return rows.selectExpr("*", f"{chosen('shape', WRITES[name])} AS text") if name in WRITES else rows


def with_views(*names: str) -> str:
    """The common table expressions of the views for DuckDB; a query follows."""

    def one(name: str) -> str:
        source, columns, where = VIEWS[name]
        rows = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where}"
        return f"{name} AS (SELECT *, {chosen('shape', WRITES[name])} AS text FROM ({rows}))" if name in WRITES else f"{name} AS ({rows})"

    return "WITH " + ",\n".join(map(one, names)) + "\n"
