import numpy as np
import pandas as pd
import pytest

from larder.llm import embedding_dedup
from tests.llm.data import table

SCHEMA = "vec_id long, embedding array<float>, label int, component long, id string"


def brute(rows, cosine):
    ok = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, (np.array(v, np.float64), label))
    ids = sorted(ok)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = dict.fromkeys(ids, 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, la), (y, lb) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (n.get(i, 0), find(i) if i in parent else i) for i, *_ in rows}


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA)
    got = embedding_dedup.near_duplicates(df, **options).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows, options.get("cosine", 0.98))
    return got


def test_given_embeddings(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, "embeddings", "/root/testdata/sf0.001").collect()]
    random = np.random.default_rng(8)
    rows += [(10_000 + i, (np.array(v) + random.normal(size=len(v)) * 0.02 * (1 + i % 3)).tolist(), label) for i, v, label in rows[:150]]
    assert any(r.n_links for r in check(spark, rows))


def test_dense_groups_take_the_exact_way(spark):
    """Cells and components larger than the window: all links count, and a chain through one centre holds."""
    random = np.random.default_rng(3)
    centre = random.normal(size=16)
    rows = [(500, centre.tolist(), 1)]
    rows += [(i, (centre + random.normal(size=16) * 0.17 * (1 + i % 2)).tolist(), 1 + i % 7 // 6) for i in range(60)]
    check(spark, rows, window=8, block=6)


def test_copies_count_as_links(spark):
    random = np.random.default_rng(5)
    hot, other = random.normal(size=12), random.normal(size=12)
    rows = [(100 + i, hot.tolist(), 1) for i in range(70)] + [(i, (hot + random.normal(size=12) * 0.15).tolist(), 1) for i in range(12)]
    rows += [(300 + i, other.tolist(), 1 + i % 2) for i in range(9)] + [(400, hot.tolist(), 2), (401, hot.tolist(), None)]
    check(spark, rows, window=8, block=6)
    df = spark.createDataFrame(rows, SCHEMA.replace(", component long, id string", ""))
    v = embedding_dedup.usable(df)
    _, one, several = embedding_dedup.collapse(v, embedding_dedup._signed(v, 1))
    assert several is None and one.count() == 1 + 12 + 2 + 1


def test_an_id_with_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 1), (5, b, 1), (7, a, 1), (8, a, 1), (9, b, 1), (3, [0.0, 0.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {5: (3, 5, True), 7: (2, 5, False), 8: (2, 5, False), 9: (1, 5, False), 3: (0, 3, True)}


def test_odd_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [1.0, 2.0], 1), (11, [], 1), (2, [2.0, 4.0, 6.0], 1)]
    got = check(spark, rows)
    assert sum(r.vec_id == 2 for r in got) == 2
    df = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(df).count() == 0


@pytest.mark.parametrize("most", [1, 50, 5000, 10**9])
def test_passes_keep_the_promised_recall(most):
    bits, passes = embedding_dedup.plan_passes(most, 0.98)
    assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** passes <= embedding_dedup.MISS


@pytest.mark.parametrize("dim", [24, 300])
def test_recall_on_a_large_table(spark, dim):
    """Links of 12,000 vectors of one label, many at the very threshold, against all pairs; for 300 axes the sketch is a projection."""
    random = np.random.default_rng(dim)
    base = random.normal(size=(6000, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = random.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = random.uniform(0.97, 0.985, len(base))[:, None]
    all_ = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side]).astype(np.float32)
    unit = all_.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = np.zeros(len(unit), int)
    for a in range(0, len(unit), 2000):
        want[a : a + 2000] = (unit[a : a + 2000] @ unit.T >= 0.98).sum(1) - 1
    assert embedding_dedup.plan_passes(len(unit), 0.98)[0] >= 6 and want.sum() > 2000
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(unit)), "embedding": all_.tolist(), "label": 1}), "vec_id long, embedding array<float>, label int")
    got = np.zeros(len(unit), int)
    for r in embedding_dedup.near_duplicates(df).collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() / want.sum() >= 0.9999


def test_sketches_keep_every_link():
    """Distances of rounded sketches never hide a pair at the threshold."""
    random = np.random.default_rng(2)
    for dim in (3, 64, 400):
        x = random.normal(size=(400, dim))
        y = np.repeat(x[:20], 20, 0) + random.normal(size=x.shape) * np.linalg.norm(x[0]) * 0.2 / np.sqrt(dim)
        frame = pd.DataFrame({"vec_id": range(800), "dim": dim, "label": 1, "v": list(np.concatenate([x, y]))})
        out = next(iter(embedding_dedup.signed_frames(iter([frame]), 1)))
        out = frame.drop(columns="v").merge(out[["vec_id", "sketch"]], on="vec_id")
        unit = embedding_dedup._matrix(frame["v"])
        linked = unit @ unit.T >= 0.98
        np.fill_diagonal(linked, False)
        near = embedding_dedup._near(out, 0.98)
        assert linked.sum() > 100 and not (linked & ~near).any()
