"""Deletes that cascade over foreign keys: a walk down a table of keys, with sets of doomed ids.

Each table is visited after all its parents. Its doomed rows are those that name a doomed parent by any
of its keys; their ids go on to its own children. What travels is ids, never rows, and a table without
children is only filtered.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Key(NamedTuple):
    """Rows of ``child`` go with the row of ``parent`` whose ``parent_id`` their ``column`` names."""

    child: str
    column: str
    parent: str
    parent_id: str = "id"


#: What goes with a recipe, with a cook and with a post.
KITCHEN_KEYS = (
    Key("ratings", "recipe_id", "recipes"),
    Key("cook_log", "recipe_id", "recipes"),
    Key("flags", "recipe_id", "recipes"),
    Key("lines", "recipe_id", "recipes"),
    Key("method", "recipe_id", "recipes"),
    Key("posts", "cook_log_id", "cook_log"),
    Key("posts", "recipe_id", "recipes"),
    Key("comments", "post_id", "posts"),
    Key("recipe_queue", "recipe_id", "recipes"),
    Key("photos", "cook_log_id", "cook_log"),
    Key("photos", "recipe_id", "recipes"),
    Key("snapshots", "recipe_id", "recipes"),
    Key("snapshots", "cook_log_id", "cook_log"),
)


def parents_first(keys: Iterable[Key], root: str) -> list[str]:
    """The tables that a delete from ``root`` reaches, parents before children; keys that form a ring are refused."""
    keys = list(keys)
    reached, todo = {root}, [root]
    while todo:
        at = todo.pop()
        for k in keys:
            if k.parent == at and k.child not in reached:
                reached.add(k.child)
                todo.append(k.child)
    order: list[str] = []
    while len(order) < len(reached):
        ready = [t for t in sorted(reached - set(order)) if all(k.parent in order or k.parent not in reached for k in keys if k.child == t and t != root)]
        if not ready:
            raise ValueError(f"keys form a ring among {sorted(reached - set(order))}")
        order += ready
    return order


def delete(tables: dict[str, DataFrame], root: str, gone: DataFrame, keys: Iterable[Key] = KITCHEN_KEYS) -> dict[str, DataFrame]:
    """What is left of each table reached when the rows of ``root`` with the ids ``gone`` (one column) are deleted.

    A null key names no parent, so its row stays; a key that points nowhere keeps its row too. Tables of the
    keys that aren't given are left out, with all that hangs on them alone.
    """
    keys = [k for k in keys if k.child in tables and k.parent in tables]
    doomed = {root: gone.toDF("_gone").where("_gone IS NOT NULL").distinct()}
    left: dict[str, DataFrame] = {}
    for name in parents_first(keys, root):
        rows = tables[name]
        own = [k for k in keys if k.child == name and k.parent in doomed]
        ids = {k.parent_id for k in keys if k.parent == name}
        if len(ids) > 1:
            raise ValueError(f"children name {name} by different columns: {sorted(ids)}")
        if name == root:
            (by,) = ids or {"id"}
            left[name] = rows.join(doomed[root], F.col(by) == F.col("_gone"), "left_anti")
            continue
        left[name] = reduce(lambda df, k: df.join(doomed[k.parent], F.col(k.column) == F.col("_gone"), "left_anti"), own, rows)
        if ids:
            (by,) = ids
            named = [rows.select(F.col(by).alias("_id"), k.column).join(doomed[k.parent], F.col(k.column) == F.col("_gone"), "left_semi").select("_id") for k in own]
            doomed[name] = reduce(DataFrame.unionByName, named).select(F.col("_id").alias("_gone")).where("_gone IS NOT NULL").distinct()
    return left
