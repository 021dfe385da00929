"""Cascading deletes over a table of keys, layered readers, and ordered names."""

import pytest
from pyspark.sql import functions as F

from larder.operators import closure, imports
from larder.operators.rows import by_name


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_delete_goes_down_every_branch(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "recipes": make([(1,), (2,), (3,)], "id long"),
        "cook_log": make([(10, 1), (11, 2), (12, 3), (13, None)], "id long, recipe_id long"),
        "posts": make([(20, 10, None), (21, None, 1), (22, 11, None), (23, None, None), (24, 99, None)], "id long, cook_log_id long, recipe_id long"),
        "comments": make([(30, 20), (31, 21), (32, 22), (33, 23), (34, None)], "id long, post_id long"),
        "ratings": make([(1, 5), (2, 4), (2, 4), (None, 3)], "recipe_id long, rating long"),
        "photos": make([(40, 2, 10), (41, 2, None), (42, 1, None)], "id long, recipe_id long, cook_log_id long"),
    }
    left = closure.delete(tables, "recipes", make([(1,), (None,), (1,), (77,)], "gone long"))
    assert ids(left["recipes"]) == [2, 3] and sorted(ids(left["cook_log"])) == [11, 12, 13]
    assert ids(left["posts"]) == [22, 23, 24] and ids(left["comments"]) == [32, 33, 34]
    assert ids(left["photos"]) == [41] and left["ratings"].count() == 3
    untouched = closure.delete(tables, "recipes", make([], "gone long"))
    assert {n: df.count() for n, df in untouched.items()} == {n: df.count() for n, df in tables.items()}


def test_keys_are_walked_parents_first():
    order = closure.parents_first(closure.KITCHEN_KEYS, "recipes")
    assert order[0] == "recipes" and len(order) == 11
    assert all(order.index(k.parent) < order.index(k.child) for k in closure.KITCHEN_KEYS)
    assert closure.parents_first(closure.KITCHEN_KEYS, "posts") == ["posts", "comments"]
    with pytest.raises(ValueError, match="ring"):
        closure.parents_first([closure.Key("b", "a_id", "a"), closure.Key("c", "b_id", "b"), closure.Key("b", "c_id", "c")], "a")


def test_readers_stop_at_the_first_that_reads(spark):
    from larder.functions.pages import SCHEMA

    def reader(sign, code):
        def read(page):
            known = {"name": F.when(page.contains(sign), F.concat(F.lit(sign), page)), "refusal": F.when(~page.contains(sign), code)}
            return F.struct(*(known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA.fields))

        return read

    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "ab"), (4, "u", "c"), (5, "u", None)], "id long, url string, text string")
    found = imports.read(pages, (("first", reader("a", "NO_A")), ("second", reader("b", "NO_B")))).collect()
    got = {r.id: (r.layer, r.name, r.refusal, [(x.layer, x.code) for x in r.refusals]) for r in found}
    both = [("first", "NO_A"), ("second", "NO_B")]
    assert got == {1: ("first", "aa", None, []), 2: ("second", "bb", None, both[:1]), 3: ("first", "aab", None, []), 4: (None, None, "NO_A", both), 5: (None, None, "NO_A", both)}
    assert imports.read(pages, ()).where("layer IS NULL AND size(refusals) = 0").count() == 5


def test_names_by_collation(spark):
    df = spark.createDataFrame([("b", 1), ("A", 2), ("é", 3), ("a", 4), ("B", 5), ("f", 6)], "name string, id long")
    order = lambda c: "".join(r.name for r in by_name(df, "name", "id", collation=c).collect())
    assert (order("UTF8_BINARY"), order("UTF8_LCASE"), order("UNICODE")) == ("ABabfé", "AabBfé", "aAbBéf")
