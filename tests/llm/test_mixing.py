import hashlib
import math
from collections import defaultdict

import pytest

from larder.llm import mixing
from larder.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_TOTAL, MIX_WEIGHTS
from tests.llm.data import docs, table


def leaf_of(r):
    digits = ""
    for c in reversed(r.source or ""):
        if not c.isdigit() or len(digits) == 9:
            break
        digits = c + digits
    return (f"domain{int(digits) % 4}" if digits else "other", r.lang or "", r.source or "")


def share(budget, children):
    """children: {name: (capacity, weight)}: raise the level until the budget is used or all are full."""
    got, open_ = dict.fromkeys(children, 0.0), {c for c, (cap, w) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] <= budget * children[c][1] / total + 1e-12}
        if not full:
            for c in open_:
                got[c] = budget * children[c][1] / total
            break
        for c in full:
            got[c] = float(children[c][0])
            budget -= children[c][0]
        open_ -= full
    return got


def brute(rows, total, weights, epochs, seed):
    tokens = [math.ceil(len((r.text or "").encode()) / mixing.TOKEN_BYTES) for r in rows]
    available = defaultdict(int)
    for r, n in zip(rows, tokens, strict=True):
        available[leaf_of(r)] += n
    weight = lambda path: weights.get("/".join(path), 1.0)
    budget = {(): float(min(math.floor(sum(available.values()) * total), sum(available.values()) * epochs))}
    for level in (1, 2, 3):
        nodes = defaultdict(int)
        for leaf, n in available.items():
            nodes[leaf[:level]] += n * epochs
        families = defaultdict(dict)
        for node, cap in nodes.items():
            families[node[:-1]][node] = (cap, weight(node))
        budget = {n: b for parent, family in families.items() for n, b in share(budget[parent], family).items()}
    out = []
    for r, n in zip(rows, tokens, strict=True):
        leaf = leaf_of(r)
        b, a = math.floor(budget[leaf] + 1e-6), available[leaf]
        whole = b // a if a else 1
        key = lambda x: hashlib.md5(f"{seed}:{whole + 1}:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest()  # noqa: E731, B023
        before = sum(m for x, m in zip(rows, tokens, strict=True) if leaf_of(x) == leaf and key(x) <= key(r))
        out.append((r.doc_id, *leaf, n, a, b, whole + int(before <= b - whole * a and whole < epochs)))
    return sorted(out, key=str)


def check(df, *how):
    got = mixing.report(df, *how).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(df.collect(), *how)
    return got


@pytest.mark.parametrize("how", [(MIX_TOTAL, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED), (0.9, {}, 1, 3), (2.5, {"domain1": 0.0, "domain2": 9.0}, 3, 1), (9.0, {}, 2, 0)])
def test_given_documents(spark, how):
    df = table(spark, "documents", "/root/testdata/sf0.001")
    got = check(df, *how)
    taken = sum(r.copies * r.tokens for r in got)
    assert taken <= sum(r.tokens for r in got) * how[0]


def test_odd_cases(spark):
    df = docs(spark)
    check(df, 0.7, {}, 2, 5)
    assert mixing.mix(df, 0.7, {}, 2, 5).columns == df.columns
    assert mixing.report(df.where("false"), 0.7).count() == 0
    total = sum(r.copies for r in mixing.report(df, 1.6, {}, 2, 5).collect())
    assert mixing.mix(df, 1.6, {}, 2, 5).count() == total


def test_large_tables_of_leaves_are_joined_by_shuffle(spark, monkeypatch):
    df = table(spark, "documents", "/root/testdata/sf0.001")
    want = sorted(map(tuple, mixing.report(df, 0.8, {}, 2, 5).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, mixing.report(df, 0.8, {}, 2, 5).collect())) == want
