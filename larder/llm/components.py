"""Connected components of an undirected edge table, without collecting any of it.

Each round joins two steps. In the large star every vertex ties its larger neighbours to the
smallest vertex it knows; in the small star every vertex ties itself and its smaller neighbours to
the smallest one. Both keep connectivity, and the table ends as stars around each smallest vertex.
Rounds are logarithmic in the longest path in practice, and they end as soon as the table is seen to be
stars: another round to find that nothing changes would cost as much as the others. Minima are partial
aggregates, so a vertex with very many edges isn't gathered anywhere. A round is five shuffles: both
directions of an edge, and both rows that it leaves, are made in its row and not by unions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint


def _rows(table: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v) for each of the named pairs of columns in each row of ``table``."""
    return table.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _rows(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = _downward(edges)
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _rows(down.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no larger end of these distinct edges (u > v) has a second edge."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").first() is None


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Edges (u, v) to rows (id, component): every vertex of an edge with the smallest vertex it reaches.

    Vertices are of any one type that has an order. Self loops, nulls and repeated edges change nothing; vertices of self loops alone are left out.
    An empty table gives an empty result.
    """
    now = checkpoint(_downward(edges).where("u <> v").distinct())
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = checkpoint(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components had not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
