"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Two permutations make every coordinate of a signature. The first spreads a text's word shingles
over a ring of 2**32 places; the second, shifted by k places around the ring, orders them for
coordinate k. Bands of coordinates put similar texts into one bucket.

Links are then found on full sets, in two steps that lose none of the texts that share a bucket:

1. Within each bucket every text is compared with the bucket's smallest document. Verified links
   give first components.
2. Only buckets that still hold several components matter. Small ones compare their texts of
   different components with each other. Texts of large ones are first compared with the text that
   stands in the most and largest of them: variants lie around it, while the smallest document may be
   a far one. What is left in different components is joined on the rarest shingles of each set (prefix
   filter): two sets of the wanted similarity always share one of those, so that no pair is lost and no
   bucket is expanded into all its pairs.

Equal sets are one class from the start, so thousands of exact copies count as one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import checkpoint, free_names, mix64, ship, small_batches, text_bytes, text_or_empty
from larder.llm.components import connected_components

ship(__name__)

#: Bands of rows each: a pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS,
#: 3e-8 at 0.85 and 3e-6 at 0.8.
BANDS, ROWS = 24, 4
#: Buckets with more texts than this go through the prefix filter.
SMALL_BUCKET = 48
SHINGLE = 5
#: Bytes of text that are hashed at once; a kernel holds some fifty bytes for each.
SLICE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's word shingles.

    A text with fewer words than a shingle has its whole word sequence as one; a text without words has none.
    """
    none = np.zeros(0, np.uint64)
    if not len(raw):
        return [none] * (len(offsets) - 1)
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word never crosses a row
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return [none] * (len(offsets) - 1)
    odd = np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(raw))))[: len(raw)] if starts[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    powers = np.cumprod(np.full(int(place.max()) + 1, odd, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[raw] * powers[place], dtype=np.uint64)])
    word = mix64(sums[ends + 1] - sums[starts] + (ends + 1 - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    out = []
    n = len(word)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + word[i : n - words + 1 + i] if len(rolled) else rolled
    rolled = mix64(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in word[a:b]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(none)
    return out


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit words, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation at the first's places shifted by k."""
    ring = (mix64(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(ring), 1024):
        np.minimum(least, _second(ring[None, i : i + 1024] + shifts).min(1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    key = mix64(np.arange(1, len(least) // rows + 1, dtype=np.uint64))
    for column in least.reshape(-1, rows).T:
        key = mix64(key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _identities(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums for each set, that together stand for it."""
    one = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
    two = [int(mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return [pa.array(one, pa.int64()), pa.array(two, pa.int64())]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    lengths = np.concatenate([[0], np.cumsum([len(k) for k in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int64()))


def _text_keys(text: Column) -> list[Column]:
    """A text's identity in 128 bits."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, n, fp1, fp2, bands): the text's identity, size of its set, the set's identity, and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3, size=SLICE):
            sets = shingle_hashes(*text_bytes(batch.column(3)), words)
            keys = [band_keys(signature(s, bands * rows), rows) if len(s) else np.zeros(0, np.int64) for s in sets]
            arrays = [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), *_identities(sets), _lists(keys)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "k1", "k2", "n", "fp1", "fp2", "bands"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", *_text_keys(F.col("text")), "text")
    return kept.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, fp1 long, fp2 long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp1, fp2, items): each text's sorted distinct shingle hashes, with the identity of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, size=SLICE):
            sets = shingle_hashes(*text_bytes(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_identities(sets), _lists(sets)], ["doc_id", "fp1", "fp2", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp1 long, fp2 long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose sets, counted in full, have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rid").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("rid").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _may_link(percent: int):
    """Sets whose sizes differ too much can't be similar enough."""
    return 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (rid, n, component) in different components that share one of their rarest shingles."""
    items = checkpoint(members.join(sets, "rid").select("rid", "n", "component", F.explode("items").alias("item")))
    often = items.groupBy("item").agg(F.count("*").alias("often")).where("often > 1")
    n_rare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # shingles of one member alone come first in the order but can't be shared
    alone = F.col("n") - F.count("*").over(Window.partitionBy("rid"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("often", "item"))
    rare = items.join(often, "item").withColumn("rank", rank + alone).where(F.col("rank") <= n_rare)
    mixed = rare.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("item")
    rare = checkpoint(rare.join(mixed, "item", "left_semi").select("item", "rid", "n", "component", "rank"))
    u = rare.select("item", F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"), (F.col("n") - F.col("rank")).alias("ru"))
    v = rare.select("item", F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), (F.col("n") - F.col("rank")).alias("rv"))
    # at the first item that two sets share, in the common order, only what follows in both can still be shared
    enough = (100 + percent) * (1 + F.least("ru", "rv")) >= percent * (F.col("nu") + F.col("nv"))
    return u.join(v, "item").where("u < v and cu <> cv").where(_may_link(percent)).where(enough).select("u", "v").distinct()


def _around_cores(open_: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, members) of open buckets (key, rid, n, members, component): links (u, v) to each bucket's core, and (rid, n, component) with the components that they make.

    The core is the text with the most companions over all the buckets.
    """
    heavy = open_.join(open_.groupBy("rid").agg(F.sum("members").alias("weight")), "rid")
    cores = heavy.groupBy("key").agg(F.max(F.struct("weight", "rid", "n", "component")).alias("core"))
    pairs = open_.join(cores, "key").where("component <> core.component").withColumn("nu", F.col("core.n")).withColumn("nv", F.col("n")).where(_may_link(percent))
    links = checkpoint(_verified(pairs.select(F.least("core.rid", "rid").alias("u"), F.greatest("core.rid", "rid").alias("v")).distinct(), sets, percent))
    members = checkpoint(open_.select("rid", "n", "component").distinct())
    place = members.select("rid", "component")
    between = links.join(place.toDF("u", "cu"), "u").join(place.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    part = connected_components(between).toDF("component", "joined")
    return links, members.join(part, "component", "left").select("rid", "n", F.coalesce("joined", "component").alias("component"))


def _classes(docs: DataFrame, percent: int, words: int, bands: int, rows: int, small_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (doc_id, k1, k2, n, fp1, fp2), a class (n, fp1, fp2, rid, least doc_id) for each different set, and links (u, v) between rids.

    An id may have several texts, so sets and not ids are compared; a row number ``rid`` stands for a class.
    """
    signed = checkpoint(signatures(docs, bands, rows, words).withColumn("rid", F.monotonically_increasing_id()))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min(F.struct("doc_id", "rid")).alias("rep"))
    classes = checkpoint(classes.select("n", "fp1", "fp2", "rep.rid", F.col("rep.doc_id").alias("least")))
    keyed = signed.join(classes.select("rid"), "rid", "left_semi").select("rid", "n", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("rid", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
    shared = checkpoint(keyed.join(heads, "key").select("key", "rid", "n", F.col("head.rid").alias("u"), F.col("head.n").alias("nu"), "members"))
    wanted = classes.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", F.col("least").alias("doc_id"), "fp1", "fp2")
    own = shingle_sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), words)
    # an id's equal texts meet by the keys of the join, so sets are shuffled once
    sets = checkpoint(own.dropDuplicates(["doc_id", "fp1", "fp2"]).join(wanted, ["doc_id", "fp1", "fp2"]).select("rid", "items"))

    first = shared.withColumn("nv", F.col("n")).where("u <> rid").where(_may_link(percent)).select("u", F.col("rid").alias("v")).distinct()
    links = checkpoint(_verified(first, sets, percent))
    part = connected_components(links)
    placed = checkpoint(shared.join(part, shared["rid"] == part["id"], "left").select("key", "rid", "n", "members", F.coalesce("component", "rid").alias("component")))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = placed.join(split, "key", "left_semi")
    small = open_.where(F.col("members") <= small_bucket)
    u = small.select("key", F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"))
    v = small.select("key", F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"))
    second = u.join(v, "key").where("u < v and cu <> cv").where(_may_link(percent)).select("u", "v")
    large = checkpoint(open_.where(F.col("members") > small_bucket))
    if large.first() is not None:
        around, members = _around_cores(large, sets, percent)
        links = links.unionByName(around)
        second = second.unionByName(_prefix_pairs(members, sets, percent))
    more = _verified(second.distinct(), sets, percent)
    return signed.drop("bands", "rid"), classes, links.unionByName(more)


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of word shingles.
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that document.
    Null, empty and blank texts have the empty set and link with nothing. Repeated rows come back
    as often as they are there; rows that share a doc_id are one vertex with the links of all their texts.
    Rows without a doc_id link with nothing and are kept. An empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    signed, classes, links = _classes(docs, percent, words, bands, rows, small_bucket)
    id_of = classes.select("rid", "least")
    between = links.join(id_of.toDF("u", "a"), "u").join(id_of.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    copies = signed.join(classes, ["n", "fp1", "fp2"]).where("least <> doc_id").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    whole = connected_components(between.unionByName(copies))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(whole, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 80, words: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked texts those of the smallest doc_id stay.

    Texts are judged and not ids: where an id has several texts, each stays or goes with its own group.
    Equal rows stay or go together. Rows with a null doc_id can't be linked and stay. Columns are those of ``docs``.
    """
    signed, classes, links = _classes(docs.where("doc_id is not null"), percent, words, bands, rows, small_bucket)
    part = connected_components(links)
    grouped = classes.join(part, F.col("rid") == F.col("id"), "left").select("n", "fp1", "fp2", "least", F.coalesce("component", "rid").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("stays"))
    grouped = grouped.join(least, "component").select("n", "fp1", "fp2", "stays")
    gone, k1, k2 = free_names(docs, "_gone", "_k1", "_k2")
    copies = signed.join(grouped, ["n", "fp1", "fp2"]).where("doc_id <> stays").select(F.col("doc_id").alias(gone), F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    one, two = _text_keys(text_or_empty())
    marked = F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (one == F.col(k1)) & (two == F.col(k2))
    return docs.join(copies, marked, "left_anti")


def oracle(percent: int) -> str:
    """The same in DuckDB SQL, over all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
least AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN least ON least.u = doc_id
"""
