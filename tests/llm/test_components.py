import random

from larder.llm import components
from larder.llm.components import connected_components


def test_equals_union_find(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(60)] + [(random.randrange(2000, 2500), random.randrange(2000, 2500)) for _ in range(240)]
    random.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "u long, v long")).collect()
    assert len(got) == len(linked) and {r.id: r.component for r in got} == {x: find(x) for x in linked}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_settled_stars_cost_no_round(spark, monkeypatch):
    """Every checkpoint after the first is a round of shuffles; stars take none, and what a round has made stars takes no further one."""
    kept, plain = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: kept.append(1) or plain(df))
    stars = [(1, 5), (6, 1), (1, 7), (2, 9), (9, 2)]
    got = connected_components(spark.createDataFrame(stars, "u long, v long")).collect()
    assert sorted((r.id, r.component) for r in got) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 1), (9, 2)] and len(kept) == 1
    kept.clear()
    hub_is_largest = [(9, 1), (9, 2), (9, 3), (4, 8)]
    got = connected_components(spark.createDataFrame(hub_is_largest, "u long, v long")).collect()
    assert sorted((r.id, r.component) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 4), (8, 4), (9, 1)] and len(kept) == 2
