"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

Leaves are the sources of a language of a domain. Budgets go down the tree: at each node the children
share its budget by weight, none gets more than its subtree can give (its tokens times the most
epochs), and what one child can't give its siblings take, by weight. A whole subtree's shortage is
seen in its capacity, so that it falls to the ancestors' siblings only after its own.

A leaf gives whole epochs while the budget lasts, then a prefix of the next epoch in that epoch's own
seeded order. A prefix of an order is what comes before one key, so a leaf's choice is one cut-off
key. It is found from sums over buckets of keys, then inside the one bucket where the budget ends:
a source with a third of all rows is spread over its buckets, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import checkpoint, columns_of, free_names, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Bytes taken for one token.
TOKEN_BYTES = 4
#: Hex digits of a key that name its bucket: 4,096 buckets for each leaf.
BUCKET_DIGITS = 3
#: A table of leaves up to this many rows (some 10 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_LEAVES = 50_000
DOMAINS = 4


def leaf_columns() -> dict[str, Column]:
    """A document's leaf and its tokens. The domain follows from the number that ends a source's name."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int")
    return {
        "domain": F.coalesce(F.concat(F.lit("domain"), (number % DOMAINS).cast("string")), F.lit("other")),
        "lang": F.coalesce("lang", F.lit("")),
        "source": F.coalesce("source", F.lit("")),
        "tokens": F.ceil(F.octet_length(text_or_empty()) / TOKEN_BYTES).cast("long"),
    }


def _weight(path: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    return F.coalesce(table[path], F.lit(1.0))


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget``: the parent's budget shared by weight up to each capacity.

    With children in order of capacity per weight, those that the level of the remaining budget
    covers are full; the rest get the level reached at the first that isn't.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), name)
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("level", F.when(F.col("weight") > 0, (F.col("of") - full) / rest)).withColumn("ratio", ratio)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(Window.partitionBy(*parents))
    budget = F.when(F.col("weight") <= 0, 0.0).when(F.col("level") >= F.col("ratio"), F.col("capacity").cast("double")).otherwise(level * F.col("weight"))
    return nodes.withColumn("budget", budget).drop("level", "ratio")


def budgets(leaves: DataFrame, total: float, weights: dict[str, float], max_epochs: int) -> DataFrame:
    """(domain, lang, source, available, budget) from (domain, lang, source, available).

    ``total`` is a share of all available tokens. ``weights`` has the weight of a path such as
    ``domain1`` or ``domain1/de/src5``; others weigh 1. A weight of 0 gives nothing.
    """
    leaves = leaves.withColumn("capacity", F.col("available") * max_epochs)
    whole = leaves.groupBy(F.lit(1).alias("root")).agg(F.least(F.floor(F.sum("available") * total), F.sum("capacity")).cast("double").alias("of"))
    above, parents = whole, ["root"]
    for i, name in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = leaves.withColumn("root", F.lit(1)).groupBy("root", *keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.concat_ws("/", *keys), weights)).join(above, parents)
        above = _share(nodes, parents, name).select("root", *keys, F.col("budget").alias("of"))
        parents = ["root", *keys]
    return leaves.join(above.drop("root"), list(LEVELS)).select(*LEVELS, "available", F.floor(F.col("of") + 1e-6).cast("long").alias("budget"))


def order_key(seed: int, epoch: Column) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


#: What a chosen document gets from its leaf.
FROM_LEAF = ("available", "budget", "whole", "rest", "cut")


def choose(docs: DataFrame, total: float, weights: dict[str, float] | None = None, max_epochs: int = 4, seed: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (doc_id, text, lang, source, ...) with its leaf and the epochs that take it, and the names of these columns.

    The names are by ``domain``, ``lang``, ``source``, ``tokens``, ``available``, ``budget`` and ``copies``, and clash
    with no column of ``docs``. Null lang and source are leaves of their own, null and empty texts weigh
    no tokens. Rows that share a doc_id have one place in the order and are taken or left together
    within a leaf. An empty table gives an empty result.
    """
    leaf = [f"leaf_{k}" for k in LEVELS]
    narrow = docs.select("doc_id", *(c.alias(f"leaf_{k}") for k, c in leaf_columns().items()))
    leaves = narrow.groupBy(*(F.col(f"leaf_{k}").alias(k) for k in LEVELS)).agg(F.sum("leaf_tokens").alias("available"))
    leaves = budgets(leaves, total, weights or {}, max_epochs)
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(1)).cast("long")
    leaves = leaves.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("available"))
    leaves = checkpoint(leaves.select(*(F.col(k).alias(f"leaf_{k}") for k in LEVELS), "available", "budget", "whole", "rest"))
    small = leaves.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda df: df)
    keyed = narrow.join(hint(leaves), leaf).withColumn("key", order_key(seed, F.col("whole") + 1)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*leaf, "bucket").agg(F.sum("leaf_tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("key").alias("last"))
    reached = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket"))
    sums = checkpoint(sums.withColumn("reached", reached))
    under = sums.where("reached <= rest").groupBy(*leaf).agg(F.max("last").alias("cut"))
    ends = sums.where("reached > rest and reached - tokens <= rest").select(*leaf, "bucket", (F.col("reached") - F.col("tokens")).alias("before"))
    inside = keyed.join(hint(ends), [*leaf, "bucket"])
    within = F.sum("leaf_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("key")) + F.col("before")
    last = inside.withColumn("within", within).where("within <= rest").groupBy(*leaf).agg(F.max("key").alias("cut"))
    cuts = under.unionByName(last).groupBy(*leaf).agg(F.max("cut").alias("cut"))
    leaves = checkpoint(leaves.join(cuts, leaf, "left"))

    wanted = [*LEVELS, "tokens", "copies", *FROM_LEAF]
    name = dict(zip(wanted, free_names(docs, *(f"leaf_{k}" for k in wanted)), strict=True))
    of = dict(zip(LEVELS, free_names(docs, *(f"of_{k}" for k in LEVELS)), strict=True))
    table = leaves.select(*(F.col(f"leaf_{k}").alias(of[k]) for k in LEVELS), *(F.col(k).alias(name[k]) for k in FROM_LEAF))
    placed = docs.withColumns({name[k]: c for k, c in leaf_columns().items()}).join(hint(table), [F.col(name[k]) == F.col(of[k]) for k in LEVELS])
    taken = F.coalesce(order_key(seed, F.col(name["whole"]) + 1) <= F.col(name["cut"]), F.lit(False)) & (F.col(name["whole"]) < max_epochs)
    return placed.withColumn(name["copies"], F.col(name["whole"]) + taken.cast("long")), name


def mix(docs: DataFrame, total: float, weights: dict[str, float] | None = None, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """The chosen rows of ``docs``, each as often as the epochs that take it; columns are those of ``docs``."""
    placed, name = choose(docs, total, weights, max_epochs, seed)
    copies = F.col(name["copies"])
    chosen = placed.where(copies > 0)
    if max_epochs == 1:
        return chosen.select(*columns_of(docs))
    (copy,) = free_names(placed, "copy")
    return chosen.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(copy)).drop(copy)


def report(docs: DataFrame, total: float, weights: dict[str, float] | None = None, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """One row per document: its leaf, tokens, the leaf's tokens and budget, and the epochs that take it."""
    placed, name = choose(docs.select("doc_id", "text", "lang", "source"), total, weights, max_epochs, seed)
    return placed.select("doc_id", *(F.col(name[k]).alias(k) for k in (*LEVELS, "tokens")), F.col(name["available"]).alias("leaf_tokens"), F.col(name["budget"]).alias("leaf_budget"), F.col(name["copies"]).alias("copies"))


def oracle(total: float, weights: dict[str, float], max_epochs: int, seed: int) -> str:
    """:func:`report` in DuckDB SQL; weights are positive."""
    steps, above, parents = [], "SELECT 1 AS root, least(floor(sum(available) * {t}), sum(available) * {e})::DOUBLE AS share FROM leaves".format(t=total, e=max_epochs), ["root"]
    for i, name in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        path = "concat_ws('/', " + ", ".join(keys) + ")"
        weight = "CASE " + path + " " + " ".join(f"WHEN '{k}' THEN {float(w)}" for k, w in weights.items()) + " ELSE 1.0 END" if weights else "1.0"
        on, by = " AND ".join(f"n.{p} = a.{p}" for p in parents), ", ".join(parents)
        steps.append(f"""above{i} AS ({above}),
nodes{i} AS (SELECT 1 AS root, {", ".join(keys)}, (sum(available) * {max_epochs})::DOUBLE AS capacity, ({weight})::DOUBLE AS weight FROM leaves GROUP BY ALL),
leveled{i} AS (SELECT n.*, a.share AS whole, capacity / weight AS ratio,
  (a.share - coalesce(sum(capacity) OVER (PARTITION BY {", ".join("n." + p for p in parents)} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY {", ".join("n." + p for p in parents)} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM nodes{i} n JOIN above{i} a ON {on})""")
        above = f"SELECT root, {', '.join(keys)}, CASE WHEN level >= ratio THEN capacity ELSE max(CASE WHEN level < ratio THEN level END) OVER (PARTITION BY {by}) * weight END AS share FROM leveled{i}"
        parents = ["root", *keys]
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce('domain' || (nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '')::INT % {DOMAINS}), 'other') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    ceil(strlen(coalesce(text, '')) / {TOKEN_BYTES}.0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available FROM docs GROUP BY ALL),
{("," + chr(10)).join(steps)},
budgets AS ({above}),
planned AS (SELECT l.*, floor(b.share + 1e-6)::BIGINT AS budget, CASE WHEN available > 0 THEN floor(b.share + 1e-6)::BIGINT // available ELSE 1 END AS whole FROM leaves l JOIN budgets b USING (domain, lang, source)),
placed AS (
  SELECT d.*, p.available, p.budget, p.whole, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || (p.whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) RANGE UNBOUNDED PRECEDING) AS within
  FROM docs d JOIN planned p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, available AS leaf_tokens, budget AS leaf_budget, whole + (within <= budget - whole * available AND whole < {max_epochs})::INT AS copies FROM placed
"""
