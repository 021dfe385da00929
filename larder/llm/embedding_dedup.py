"""Embedding near-dedup by sorted projection passes.

Every pass hashes each vector to the signs of random projections and orders the vectors of a label
lexicographically by those bits. Each vector is compared with its neighbours, the ``WINDOW`` vectors
before and after it. Vectors that share the first ``bits`` bits are a cell of the order; two vectors at
the wanted cosine share a cell in at least one of the passes but for one case in ten million, and a
cell that fits the window is never parted, so all of its pairs are compared. Cells that don't fit are
compared by pairs of blocks as well: nothing is capped.

What travels through the passes is not the vector but a sketch: its direction, on at most ``SKETCH``
axes, in bytes, with the length of what the rounding took away. Distances of sketches leave candidate
pairs, and only vectors of candidates are fetched to verify them in double precision. It is done
twice, as large groups of near copies have many pairs: first each vector with its smallest candidate
of a window, then what candidates are left between different components. Verified pairs of all passes
are united to components.

All links of a vector lie within its component, so they are then counted exactly, in windows for
components that fit one and by pairs of blocks for larger ones.

Equal vectors of a label are one vector with a number of copies throughout, so that a vector which
holds a large share of the rows is compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpoint, parallelism, ship
from larder.llm.components import connected_components

ship(__name__)

WINDOW = 512
BLOCK = 512
#: Groups of more blocks than this use blocks four times as large, so that rows are dealt out less often.
MANY_BLOCKS = 16
#: Vectors that a cell holds on average, and the chance for a pair to share a cell in no pass.
CELL_ROWS = 128
MISS = 1e-7
KEY_BITS, MOST_BITS = 31, 24
#: Axes of a sketch; vectors with more components are projected on so many.
SKETCH = 128
#: Parts that a hot group is salted into before its rows meet the group's size.
SALTS = 32
#: A table of crowded cells up to this many rows (some MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 100_000
PLACE = ["pass", "label", "dim", "cell"]
VECTOR = ["vec_id", "label", "dim", "h1", "h2"]


def plan_passes(most: int, cosine: float, window: int = WINDOW) -> tuple[int, int]:
    """Bits of a cell for a label of ``most`` vectors, and passes for that; labels that fit a window take one pass."""
    bits = 0 if most <= window else min(MOST_BITS, max(1, math.ceil(math.log2(most / min(CELL_ROWS, window / 4)))))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree))) if agree < 1 else 1


def reach(dim: int, cosine: float, axes: int = SKETCH) -> float:
    """Greatest distance of the unrounded sketches of two unit vectors at ``cosine``; for projected ones but for MISS of the cases."""
    z, k = NormalDist().inv_cdf(1 - MISS), axes
    wider = (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3 if dim > axes else 1.0
    return math.sqrt(2 * (1 - cosine) * wider) + 1e-4


def usable(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(vec_id, label, dim, h1, h2, v) of the vectors that can link: label and components not null, all finite, not zero.

    Two hashes stand for a vector wherever its identity alone matters.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = vectors.select("vec_id", F.col(label).cast("long").alias("label"), F.col("embedding").cast("array<float>" if element == "float" else "array<double>").alias("v"))
    v = v.where("vec_id is not null and label is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.where((norm > 0) & (norm < float("inf")))
    return v.select("vec_id", "label", F.size("v").alias("dim"), F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), "v")


def _matrix(column: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column])
    return v / np.sqrt((v * v).sum(1))[:, None]


def signed_frames(frames: Iterator[pd.DataFrame], passes: int, axes: int = SKETCH) -> Iterator[pd.DataFrame]:
    """Frames with ``v`` replaced by its ``sketch`` (rounding step, length lost by it, bytes) and its ``keys``."""
    planes: dict[int, np.ndarray] = {}
    axis: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
    for frame in frames:
        for dim, part in frame.groupby("dim"):
            if dim not in planes:
                random = np.random.default_rng(dim)
                planes[dim] = random.normal(size=(dim, passes * KEY_BITS)).astype(np.float32)
                axis[dim] = np.linalg.qr(random.normal(size=(dim, axes)))[0] * math.sqrt(dim / axes) if dim > axes else np.eye(dim)
            unit = _matrix(part["v"])
            sign = (unit.astype(np.float32) @ planes[dim] > 0).reshape(len(part), passes, KEY_BITS)
            y = unit @ axis[dim]
            step = np.maximum(np.abs(y).max(1), 1e-30)[:, None].astype("<f4") / np.float32(127)
            rounded = np.rint(y / step).astype(np.int8)
            lost = np.sqrt(((y - rounded * step.astype(float)) ** 2).sum(1))[:, None].astype("<f4")
            body = np.concatenate([np.concatenate([step, lost], 1).view(np.uint8), rounded.view(np.uint8)], 1)
            yield part.drop(columns="v").assign(sketch=[r.tobytes() for r in body], keys=list((sign @ weights).astype(np.int32)))


def _signed(v: DataFrame, passes: int) -> DataFrame:
    """(vec_id, label, dim, h1, h2, sketch, keys): ``keys`` is the place of a vector in the order of each pass."""
    return v.mapInPandas(lambda frames: signed_frames(frames, passes), "vec_id long, label long, dim int, h1 long, h2 long, sketch binary, keys array<int>")


def _near(frame: pd.DataFrame, cosine: float) -> np.ndarray:
    """Which rows of one ``dim`` are candidates for a link, by their sketches."""
    raw = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4").astype(np.float32)
    x = raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1]
    square = (x * x).sum(1)
    far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
    ids = frame["vec_id"].to_numpy()
    return (far <= reach(int(frame["dim"].iloc[0]), cosine) + head[:, 1][:, None] + head[:, 1][None, :]) & (ids[:, None] != ids[None, :])


def _windows(frames: Iterator[pd.DataFrame], group: list[str], window: int) -> Iterator[tuple[pd.DataFrame, int]]:
    """Blocks of rows in order, each with as many of the rows before it (their number comes too) as share its first row's group."""
    held = None
    for frame in frames:
        for a in range(0, len(frame), window):
            part = frame.iloc[a : a + window]
            if held is not None:
                same = (held[group] == part.iloc[0][group].to_numpy()).all(axis=1).to_numpy()
                held = held[same].iloc[-window:]
                both = pd.concat([held, part], ignore_index=True) if len(held) else part
                yield both, len(held)
            else:
                both = part
                yield part, 0
            held = both.iloc[-window:]


def _codes(frame: pd.DataFrame, group: list[str]) -> np.ndarray:
    return frame.groupby(group, sort=False).ngroup().to_numpy()


def _close(v: np.ndarray, ids: np.ndarray, cosine: float, codes: np.ndarray | None = None) -> np.ndarray:
    close = v @ v.T >= cosine
    close &= ids[:, None] != ids[None, :]
    if codes is not None:
        close &= codes[:, None] == codes[None, :]
    return close


def _pairs_of_blocks(rows: DataFrame, group: list[str], sizes: DataFrame, block: int) -> DataFrame:
    """Each row of a group in ``sizes`` once for every pair of blocks that it is in: adds ``i`` and ``j`` (pair) and ``b`` (own block).

    Rows are salted before they meet their group's size, so that a hot group isn't joined in one task.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(SALTS)))
    blocks = F.when(F.col("size") > MANY_BLOCKS * block, F.ceil(F.col("size") / (4 * block))).otherwise(F.ceil(F.col("size") / block)).cast("int")
    dealt = salted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*group, "salt"])
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(11)), blocks).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "size", "salt")


def _placed(one: DataFrame, bits: int) -> DataFrame:
    """Every vector's place in each pass."""
    placed = one.select(*(c for c in one.columns if c != "keys"), F.posexplode("keys").alias("pass", "key"))
    return placed.withColumn("cell", F.shiftright("key", KEY_BITS - bits))


def _in_order(placed: DataFrame, crowded: DataFrame, some: bool, small: bool) -> DataFrame:
    """Rows in the order of each pass, dealt out by ranges of it. Only cells too large for a window may be parted."""
    parted: list[Column] = []
    if some:
        flag = crowded.select(*PLACE, F.lit(True).alias("crowded"))
        placed = placed.join(F.broadcast(flag) if small else flag, PLACE, "left")
        parted = [F.when(F.col("crowded"), F.col("key")).otherwise(0), F.when(F.col("crowded"), F.xxhash64("vec_id")).otherwise(0)]
    dealt = placed.repartitionByRange(parallelism(placed.sparkSession), *PLACE, *parted)
    return dealt.sortWithinPartitions("pass", "label", "dim", "key", *parted[1:], "vec_id")


def first_candidates(ordered: DataFrame, cosine: float, window: int = WINDOW) -> DataFrame:
    """(vec_id, to, more): the smallest candidate of each vector in a window, and whether it has others."""
    group = ["pass", "label", "dim"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, before in _windows(frames, group, window):
            codes, ids = _codes(part, group), part["vec_id"].to_numpy()
            for at in part.groupby("dim", sort=False).indices.values():
                near = _near(part.iloc[at], cosine) & (codes[at][:, None] == codes[at][None, :])
                near &= (at >= before)[:, None] | (at >= before)[None, :]
                hit = np.flatnonzero(near.any(1))
                own = ids[at]
                least = np.where(near[hit], own[None, :], np.iinfo(np.int64).max).min(1)
                yield pd.DataFrame({"vec_id": own[hit], "to": least, "more": near[hit].sum(1) > 1})

    return ordered.select("pass", "label", "dim", "vec_id", "sketch").mapInPandas(run, "vec_id long, to long, more boolean")


def _apart(frame: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
    """The candidate pairs between different components."""
    part, ids = frame["component"].to_numpy(), frame["vec_id"].to_numpy()
    i, j = np.nonzero(np.triu(near & (part[:, None] != part[None, :])))
    return pd.DataFrame({"u": np.minimum(ids[i], ids[j]), "v": np.maximum(ids[i], ids[j])})


def open_candidates(ordered: DataFrame, cosine: float, window: int = WINDOW) -> DataFrame:
    """(u, v): the candidates of each window between different components."""
    group = ["pass", "label", "dim"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, before in _windows(frames, group, window):
            codes = _codes(part, group)
            for at in part.groupby("dim", sort=False).indices.values():
                near = _near(part.iloc[at], cosine) & (codes[at][:, None] == codes[at][None, :])
                yield _apart(part.iloc[at], near & ((at >= before)[:, None] | (at >= before)[None, :]))

    return ordered.select("pass", "label", "dim", "vec_id", "sketch", "component").mapInPandas(run, "u long, v long")


def crowded_candidates(placed: DataFrame, crowded: DataFrame, small: bool, cosine: float, block: int = BLOCK) -> DataFrame:
    """(u, v): the candidates between different components of cells too large for a window, by pairs of blocks."""
    hint = F.broadcast if small else (lambda df: df)
    inside = placed.join(hint(crowded.select(*PLACE)), PLACE)
    open_ = inside.groupBy(*PLACE).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(*PLACE)
    dealt = _pairs_of_blocks(placed, PLACE, crowded.join(open_, PLACE, "left_semi"), block)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _apart(frame, _near(frame, cosine))

    return dealt.select(*PLACE, "i", "j", "vec_id", "sketch", "component").groupBy(*PLACE, "i", "j").applyInPandas(run, "u long, v long")


def verified(pairs: DataFrame, v: DataFrame, cosine: float) -> DataFrame:
    """Those distinct pairs (u, v) whose vectors have one label and length and the wanted cosine."""
    sides = [v.select(F.col("vec_id").alias(name), F.col("label").alias(f"label_{name}"), F.col("dim").alias(f"dim_{name}"), F.col("v").alias(f"of_{name}")) for name in ("u", "v")]
    both = pairs.join(sides[0], "u").join(sides[1], "v").where("label_u = label_v and dim_u = dim_v")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("dim_u"):
                cos = np.einsum("ij,ij->i", _matrix(part["of_u"]), _matrix(part["of_v"]))
                yield part.loc[cos >= cosine, ["u", "v"]]

    return both.select("u", "v", "dim_u", "of_u", "of_v").mapInPandas(run, "u long, v long").distinct()


def count_links(rows: DataFrame, cosine: float, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links): for each of ``rows`` (vec_id, label, dim, v, m, component) the copies (``m``) of other vectors of its component at the wanted cosine."""
    group = ["component", "label", "dim"]
    sizes = checkpoint(rows.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > window))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, before in _windows(frames, group, window):
            ids, out = part["vec_id"].to_numpy(), []
            codes = _codes(part, group)
            fresh = np.arange(len(part)) >= before
            for at in part.groupby("dim", sort=False).indices.values():
                close = _close(_matrix(part["v"].iloc[at]), ids[at], cosine, codes[at])
                # a pair counts when its later row is new, so once
                close &= fresh[at][:, None] | fresh[at][None, :]
                out.append(pd.DataFrame({"vec_id": ids[at], "n": close @ part["m"].to_numpy()[at]}))
            yield pd.concat(out)

    def count_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        ids, b = frame["vec_id"].to_numpy(), frame["b"].to_numpy()
        close = _close(_matrix(frame["v"]), ids, cosine)
        if frame["i"].iloc[0] != frame["j"].iloc[0]:
            close &= b[:, None] != b[None, :]
        return pd.DataFrame({"vec_id": ids, "n": close @ frame["m"].to_numpy()})

    if sizes.first() is None:
        small, counts = rows, None
    else:
        dealt = _pairs_of_blocks(rows, group, sizes, block)
        counts = dealt.select(*group, "i", "j", "b", "vec_id", "v", "m").groupBy(*group, "i", "j").applyInPandas(count_blocks, "vec_id long, n long")
        # a large component isn't dealt out by its number
        salted = sizes.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        small = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(SALTS))).join(salted, [*group, "salt"], "left_anti")
    few = small.repartition(parallelism(rows.sparkSession), *group).sortWithinPartitions(*group, "vec_id").mapInPandas(count, "vec_id long, n long")
    counts = few if counts is None else few.unionByName(counts)
    return counts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def collapse(v: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Equal vectors of a label as one: (members, distinct vectors, ids that stand with several vectors or None).

    Distinct vectors have the least vec_id of their copies and ``m``, the number of copies. Ids with
    several vectors are in no group of copies; each of their vectors stands for itself.
    """
    members = v.select(*VECTOR).distinct()
    whole = F.struct("label", "dim", "h1", "h2")
    several = checkpoint(members.groupBy("vec_id").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo <> hi").select("vec_id"))
    some = several.first() is not None
    if some:
        members, theirs, signed = members.join(several, "vec_id", "left_anti"), signed.join(several, "vec_id", "left_semi"), signed.join(several, "vec_id", "left_anti")
    same = VECTOR[1:]
    copies = members.groupBy(*same).agg(F.count("*").alias("m"))
    one = signed.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.any_value(F.struct("sketch", "keys")).alias("s")).join(copies, same).select(*VECTOR, "m", "s.sketch", "s.keys")
    if some:
        one = one.unionByName(theirs.dropDuplicates(VECTOR).withColumn("m", F.lit(1).cast("long")))
    return members, checkpoint(one), several if some else None


def _with_component(rows: DataFrame, part: DataFrame) -> DataFrame:
    return rows.join(part, F.col("vec_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "vec_id")).drop("id")


def links(one: DataFrame, v: DataFrame, bits: int, cosine: float, window: int = WINDOW, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) whose components are those of all links of the distinct vectors, and the vectors of all candidates."""
    placed = _placed(one, bits)
    crowded = checkpoint(placed.groupBy(*PLACE).agg(F.count("*").alias("size")).where(F.col("size") > window))
    n = crowded.count()
    how = (crowded, n > 0, n <= BROADCAST_CELLS)
    first = checkpoint(first_candidates(_in_order(placed, *how), cosine, window).groupBy("vec_id", "to").agg(F.max("more").alias("more")))
    ids = lambda df, *of: reduce(DataFrame.unionByName, (df.select(F.col(c).alias("vec_id")) for c in of)).distinct()
    fetch = lambda which: checkpoint(v.join(which, "vec_id", "left_semi").dropDuplicates(VECTOR))
    vectors = fetch(ids(first, "vec_id", "to"))
    edges = checkpoint(verified(first.select(F.least("vec_id", "to").alias("u"), F.greatest("vec_id", "to").alias("v")).distinct(), vectors, cosine))

    part = checkpoint(connected_components(edges))
    again = first.where("more").select("vec_id").distinct()
    left = open_candidates(_in_order(_placed(_with_component(one.join(again, "vec_id", "left_semi"), part), bits), *how), cosine, window)
    if n:
        left = left.unionByName(crowded_candidates(_placed(_with_component(one, part), bits), crowded, n <= BROADCAST_CELLS, cosine, block))
    left = checkpoint(left.distinct())
    if left.first() is None:
        return edges, vectors
    new = checkpoint(ids(left, "u", "v").join(vectors, "vec_id", "left_anti"))
    if new.first() is not None:
        vectors = vectors.unionByName(fetch(new))
    return edges.unionByName(verified(left, vectors, cosine)), vectors


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, label: str = "label", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null and their cosine, in double precision,
    is at least ``cosine``. Vectors that are null, zero, or hold null or non-finite components link
    with nothing; nor do those of different lengths. Repeated rows are one vector and come back as
    often as they are there; each of several vectors with one vec_id links with other ids, and the
    id has all these links; a null vec_id links with nothing. An empty table gives an empty result.
    """
    v = usable(vectors, label)
    most = v.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, passes = plan_passes(most, cosine, window)
    members, one, several = collapse(v, _signed(v, passes))
    edges, known = links(one, v, bits, cosine, window, block)
    part = checkpoint(connected_components(edges))
    rows = known.join(part, F.col("vec_id") == F.col("id")).drop("id").join(one.select(*VECTOR, "m"), VECTOR)
    n = count_links(rows.select("vec_id", "label", "dim", "v", "m", "component"), cosine, window, block)
    found = part.join(n, F.col("id") == F.col("vec_id"), "left").select("id", "component", F.coalesce("n_links", F.lit(0)).alias("n"))
    same = VECTOR[1:]
    told = one.select(*VECTOR, "m").join(found, F.col("vec_id") == F.col("id"), "left").where("m > 1 or component is not null")
    told = told.select(*same, F.coalesce("component", "vec_id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.col("vec_id").alias("of"))
    if several is not None:
        told = told.join(several, F.col("of") == several["vec_id"], "left_anti")
    # one row for each vector on the right: a vector with very many copies is split on the left by adaptive execution
    told = members.join(told, same).select(F.col("vec_id").alias("id"), "component", "n_links")
    if several is not None:
        told = told.unionByName(found.join(several, F.col("id") == several["vec_id"], "left_semi").select("id", "component", F.col("n").alias("n_links")))
    return vectors.select("vec_id").join(told, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, v) AS (SELECT u, v FROM pairs UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u),
least AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counted ON counted.u = vec_id
"""
