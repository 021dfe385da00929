"""Document fingerprints as Merkle trees over sections, paragraphs and leaves, in DataFrame functions alone.

Sections end at blank lines, paragraphs at line ends, leaves at sentence ends or after at most
``LEAF`` code points; no character is left out of a leaf. A parent's hash covers its children's
hashes in order, so equal roots mean equal texts, and going down the branches that differ leads to the
places that were edited, past all that is equal on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import text_or_empty

LEAF = 96
SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)"
LEAF_PATTERN = rf"(?s)[^.!?\n]{{0,{LEAF - 1}}}[.!?\n]|[^.!?\n]{{1,{LEAF}}}"
#: Documents of a bucket that shares one task when each document's successor is looked up.
BUCKET_ROWS = 2000
#: Most ranges of ids (a bound has 8 bytes): at this number a range grows with the table.
MOST_BUCKETS = 1 << 16


_NODE = "hash:string,n:int"
_TREE = f"array<struct<{_NODE},paragraphs:array<struct<{_NODE},leaves:array<struct<{_NODE}>>>>>>"
_EDIT = "array<struct<section:int,paragraph:int,leaf:int,old:int,new:int>>"


def _tree(text: Column) -> Column:
    """Array over sections of (hash, n, paragraphs), over paragraphs of (hash, n, leaves) and over leaves of (hash, n)."""

    def node(children: Column, name: str) -> Column:
        return F.struct(F.md5(F.concat_ws(",", children["hash"])).alias("hash"), F.aggregate(children["n"], F.lit(0), lambda a, n: a + n).alias("n"), children.alias(name))

    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF_PATTERN), F.lit(0)), lambda x: F.struct(F.md5(x).alias("hash"), F.length(x).alias("n")).cast(f"struct<{_NODE}>"))

    leaves = F.transform(F.split(text, SECTION_END, -1), lambda s: F.transform(F.split(s, PARAGRAPH_END, -1), paragraph))
    return F.transform(leaves, lambda s: node(F.transform(s, lambda p: node(p, "leaves")), "paragraphs")).cast(_TREE)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``<name>_tree``, ``<name>_root`` (hex) and ``<name>_leaves`` (hash, n) of a text column.

    A node's hash has 128 bits and covers its children's in order; the root has 256.
    """
    tree = f"{name}_tree"
    df = df.withColumn(tree, _tree(F.col(text)))
    root = F.sha2(F.concat_ws(",", F.col(tree)["hash"]), 256)
    return df.withColumns({f"{name}_root": root, f"{name}_leaves": F.flatten(F.flatten(F.transform(tree, lambda s: s["paragraphs"]["leaves"])))})


def fingerprint_text(name: str) -> Column:
    """The tree as text: the root, the section hashes, and the leaf hashes."""
    return F.concat_ws(":", f"{name}_root", F.array_join(F.col(f"{name}_tree")["hash"], "."), F.array_join(F.col(f"{name}_leaves")["hash"], "."))


def likeness(a: str, b: str) -> Column:
    """Dice coefficient of the distinct leaves of two trees: 1 for equal roots, 0 for nothing in common."""
    x, y = (F.array_distinct(F.col(f"{n}_leaves")["hash"]) for n in (a, b))
    total = F.size(x) + F.size(y)
    shared = 2.0 * F.size(F.array_intersect(x, y)) / total
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), 1.0).when(total == 0, 0.0).otherwise(shared)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _walk(a: Column, b: Column, path: list[Column], deeper) -> Column:
    """The edits between two lists of nodes: what they share at either end is left out, the rest is paired in order.

    ``deeper`` goes into a pair that differs; nodes that one side has beyond the other are one edit of their own.
    """
    equal = lambda x, y: F.coalesce(x["hash"] == y["hash"], F.lit(False))
    run = lambda x, y: _let(F.array_position(F.zip_with(x, y, equal), False).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.greatest(F.size(x), F.size(y))))
    none = F.array().cast(_EDIT)

    def edit(at: Column, old: Column, new: Column) -> Column:
        place = [*path, at, *(F.lit(None) for _ in range(2 - len(path)))]
        return F.array(F.struct(*(c.cast("int").alias(k) for c, k in zip([*place, old, new], ("section", "paragraph", "leaf", "old", "new"), strict=True)))).cast(_EDIT)

    def told(ends: Column) -> Column:
        head = ends["head"]
        old, new = (F.size(x) - head - ends["tail"] for x in (a, b))
        if deeper is None:
            return F.when((old > 0) | (new > 0), edit(head, old, new)).otherwise(none)
        both = F.least(old, new)
        pairs = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), lambda i: i + head), lambda i: (i < head + both) & (F.get(a, i)["hash"] != F.get(b, i)["hash"]))
        inside = F.flatten(F.transform(pairs, lambda i: deeper(F.get(a, i), F.get(b, i), [*path, i])))
        return F.concat(inside, F.when(old != new, edit(head + both, old - both, new - both)).otherwise(none))

    def ends(head: Column) -> Column:
        tail = F.least(run(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - head)
        return _let(F.struct(head.alias("head"), tail.alias("tail")), told)

    return _let(F.least(run(a, b), F.least(F.size(a), F.size(b))), ends)


def differences(a: str, b: str) -> Column:
    """Where two trees differ: (section, paragraph, leaf, old, new), found by going down differing branches alone.

    An edit stands at the lowest level that holds it: numbers of the lower levels are null. There ``old``
    nodes of the first tree became ``new`` nodes of the second, so an inserted sentence is one leaf with
    ``old`` 0. Empty for equal trees.
    """
    leaves = lambda x, y, path: _walk(x["leaves"], y["leaves"], path, None)
    paragraphs = lambda x, y, path: _walk(x["paragraphs"], y["paragraphs"], path, leaves)
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.array().cast(_EDIT)).otherwise(_walk(F.col(f"{a}_tree"), F.col(f"{b}_tree"), [], paragraphs))


def place_of(a: str, edit: Column) -> Column:
    """Code point of the first tree at which an edit starts."""
    before = lambda nodes, n: F.aggregate(F.slice(nodes, 1, F.coalesce(n, F.lit(0))), F.lit(0).cast("long"), lambda at, x: at + x["n"])
    tree = F.col(f"{a}_tree")
    section = F.get(tree, edit["section"])
    paragraph = F.get(section["paragraphs"], edit["paragraph"])
    deeper = F.coalesce(F.when(edit["paragraph"].isNotNull(), before(section["paragraphs"], edit["paragraph"])), F.lit(0)) + F.coalesce(F.when(edit["leaf"].isNotNull(), before(paragraph["leaves"], edit["leaf"])), F.lit(0))
    return before(tree, edit["section"]) + deeper


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its tree: doc_id, root, tree.

    Null texts are empty: one section and paragraph without leaves. Repeated rows stay; other columns are not read.
    """
    tree = with_tree(docs.select("doc_id", text_or_empty().alias("text")), "text", "t")
    return tree.select("doc_id", F.col("t_root").alias("root"), F.col("t_tree").alias("tree"))


def _with_bucket(docs: DataFrame, rows: int) -> DataFrame:
    """Adds ``bucket``: the range of ids, of about ``rows`` documents, that a row is in.

    Bounds are quantiles, so gaps between ids don't matter. They are one array of a scalar subquery, at
    most MOST_BUCKETS long, and searched in two steps.
    """
    wanted = min(MOST_BUCKETS, docs.count() // rows)
    if wanted < 2:
        return docs.withColumn("bucket", F.lit(0))
    step = max(1, int(wanted**0.5))
    # shares of quantiles have to be constant: one text, not an expression for each
    share = F.split(F.lit(",".join(f"{i / wanted:.9f}" for i in range(1, wanted))), ",").cast("array<double>")
    bounds = docs.agg(F.percentile_approx("doc_id", share, F.lit(10 * wanted)).alias("b")).select(F.array_sort(F.array_distinct("b")).alias("b"))
    coarse = bounds.select(F.filter("b", lambda x, i: i % step == 0))
    under = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    docs = docs.withColumns({"_fine": bounds.scalar(), "_coarse": coarse.scalar()})
    docs = docs.withColumn("_c", F.greatest(under("_coarse") - 1, F.lit(0)))
    return docs.withColumn("bucket", F.col("_c") * step + under(F.slice("_fine", F.col("_c") * step + 1, step))).drop("_c", "_fine", "_coarse")


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, next_text): ``next_text`` is the text of the document with the next greater doc_id, after the last that of the first.

    Rows that share a doc_id follow each other by text; rows without one have no place in that order and
    are followed by themselves. Ranges of ids are dealt out, each is ordered in its own task, and only each
    range's first text travels to the range before it. One task sees the numbers of the ranges, at most
    MOST_BUCKETS, and no texts.
    """
    every = docs.select("doc_id", text_or_empty().alias("text"))
    docs = _with_bucket(every.where("doc_id is not null"), rows)
    ring = Window.orderBy("bucket")
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    before = F.coalesce(F.lag("bucket").over(ring), F.last("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("bucket", "doc_id", before.alias("before"))
    heads = docs.join(F.broadcast(firsts), ["bucket", "doc_id"]).groupBy("before").agg(F.min("text").alias("head"))
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    docs = docs.withColumns({"next_text": F.lead("text").over(order), "last": F.lead("doc_id").over(order).isNull()})
    joined = docs.join(heads, (F.col("bucket") == F.col("before")) & F.col("last"), "left")
    alone = every.where("doc_id is null").select("doc_id", "text", F.col("text").alias("next_text"))
    return joined.select("doc_id", "text", F.coalesce("next_text", "head").alias("next_text")).unionByName(alone)


def edited_pairs(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, next_text, edited): each text with its second half replaced by the start of the next document."""
    placed = with_next(docs, rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return placed.select("doc_id", "text", "next_text", edited.alias("edited"))


def compare_with_edits(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """The digest of op3: each document against its edited text and its successor.

    Null texts are empty; a table of one row is its own successor, and so is every row without a doc_id;
    repeated rows follow each other. An empty table gives an empty result.
    """
    df = edited_pairs(docs, rows).withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)})
    df = with_tree(with_tree(with_tree(df, "text", "t"), "edited", "e"), "next_text", "x").withColumn("edits", differences("t", "e"))
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text("t").alias("fingerprint"),
        fingerprint_text("e").alias("edited_fingerprint"),
        likeness("t", "e").alias("near_edited"),
        likeness("t", "x").alias("near_next"),
        F.size("edits").cast("long").alias("n_edits"),
        place_of("t", F.get("edits", 0)).alias("first_difference"),
    )
