"""Choosing rows: newest, first or last of a key, numbering, and sets of keys.

All of them are aggregates or windows over a key. Where one row per key is wanted, the aggregate of a
struct is used rather than a window: it combines before the shuffle, so a key with very many rows
isn't gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``: an upsert log's state."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*(c if c in keys else F.col(f"_row.{c}") for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least by ``order``: an insert-or-ignore log's state."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    best = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*(c if c in keys else F.col(f"_row.{c}") for c in df.columns))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key, in ``order``. Spark drops rows beyond n before the shuffle too."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def by_name(df: DataFrame, name: str, *ties: str, collation: str = "UTF8_BINARY") -> DataFrame:
    """``df`` in the order of a name: binary as it is, ``UTF8_LCASE`` without regard to case, ``UNICODE`` as people sort."""
    return df.orderBy(F.collate(F.col(name), collation), *ties)


def rebuild_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that a rebuild of a derived table takes away and brings, with ``change`` gone or new; none if it is run again.

    Tables of one shape and without repeated rows; nulls are equal to nulls.
    """
    both = before.select("*", F.lit(-1).alias("_n")).unionByName(after.select("*", F.lit(1).alias("_n")))
    summed = both.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return summed.select(*before.columns, F.when(F.col("_n") < 0, "gone").otherwise("new").alias("change"))


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each undirected edge as (a, b), once."""
    rest = [c for c in edges.columns if c not in (a, b)]
    pair = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))
    return edges.select(pair.alias("_e"), *rest).select("_e.a", "_e.b", *rest).distinct()


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor an empty text."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns[:-1]), F.col(columns[-1]))


def blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def cascade(child: DataFrame, parent_keys: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child rows left when the parents in ``parent_keys`` are deleted."""
    return child.join(parent_keys.select(F.col(parent_key).alias("_gone")), F.col(child_key) == F.col("_gone"), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_there")), F.col(child_key) == F.col("_there"), "left_anti")
