import re
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import minhash
from larder.llm.common import text_bytes
from tests.llm.data import docs, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """Components over all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        near = {j for x in s for j in seen[x]}
        for j in near:
            o = len(s & sets[j][1])
            if 100 * o >= percent * (len(s) + len(sets[j][1]) - o):
                a, b = find(sets[k][0]), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            seen[x].append(k)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_given_documents(spark, percent):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    want = brute(rows, percent)
    got = minhash.near_duplicates(table(spark, "documents", "/root/testdata/sf0.001"), percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_take_the_exact_way(spark):
    """A family around one text, in buckets larger than the bound: no link may be lost."""
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(90):
        own = list(base)
        for at in random.choice(120, random.integers(1, 5), replace=False):
            own[at] = f"n{i}x{at}"
        rows.append((i, " ".join(own)))
    rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in rows]
    got = minhash.near_duplicates(docs(spark, rows), 85, small_bucket=4).collect()
    want = brute([(r[0], r[1]) for r in rows], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_variants_around_a_text_are_not_paired(spark, monkeypatch):
    """The smallest document is a far variant: it links with few, but the pairs that are left to try don't grow with the square of the family."""
    tried, plain = [], minhash._prefix_pairs

    def counted(*given):
        pairs = plain(*given)
        tried.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_prefix_pairs", counted)
    random = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(120):
        own = list(base)
        for at in random.choice(150, 2, replace=False):
            own[at] = f"n{i}x{at}"
        texts.insert(len(texts) // 2, " ".join(own))
    texts.insert(0, " ".join(f"f{at}" if at in (20, 70) else w for at, w in enumerate(base)))
    rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(docs(spark, rows), 85, small_bucket=48).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(list(enumerate(texts)), 85)
    assert len(tried) == 1 and tried[0] < len(texts)


def test_odd_cases(spark):
    df = docs(spark)
    got = minhash.near_duplicates(df, 85).collect()
    assert len(got) == df.count()
    want = brute([(r.doc_id, r.text) for r in df.collect()], 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    kept = minhash.keep_one(df, 85)
    assert kept.columns == df.columns
    assert {0, 1, 2, 5} <= {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(df.where("false"), 85).count() == 0


def test_ids_with_several_texts(spark):
    """An id is one vertex with the links of all its texts, in whatever order they come; texts that are nobody's copy stay."""
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    near_a, near_b = a.replace("w59", "other"), b.replace("w0", "other")
    given = [(1, near_a), (3, a), (3, b), (4, near_b), (9, "quite another text of a few words only")]
    for order in (given, given[::-1], [given[i] for i in (2, 0, 4, 1, 3)]):
        rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in order]
        got = minhash.near_duplicates(docs(spark, rows), 80).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (3, 1, False), (3, 1, False), (4, 1, False), (9, 9, True)]
        kept = minhash.keep_one(docs(spark, rows), 80).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(1, near_a), (3, b), (9, given[4][1])]
    rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in [(1, a), (3, a), (3, b), (3, a), (None, a)]]
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.text) for r in minhash.keep_one(docs(spark, rows), 80).collect()) == [((False, 0), a), ((True, 1), a), ((True, 3), b)]


def test_shingle_hashes_tell_texts_apart():
    import pyarrow as pa

    texts = ["a b c d e f", "a b c d e", "", "ab c d e f", "a b  c\nd e F", None, "x"]
    sets = minhash.shingle_hashes(*text_bytes(pa.array(texts)))
    assert [len(s) for s in sets] == [2, 1, 0, 1, 2, 0, 1]
    assert (sets[0] == sets[4]).all() and sets[1][0] in sets[0] and sets[3][0] not in sets[0]


def test_signature_estimates_jaccard():
    random = np.random.default_rng(1)
    x = random.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = minhash.signature(x[:2500], 512), minhash.signature(x[500:], 512)
    assert abs((a == b).mean() - 2000 / 3000) < 0.1
