"""Repeated passages against all windows of all texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import queries, suffix_dedup
from tests.llm.data import docs, table


def brute(rows, length):
    """By every window's bytes: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length if p + length < len(b) else len(b)] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def same(got, want):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(w[:5] for w in want)


def test_query_equals_all_windows(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents", "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    want = brute(rows, 400)
    assert any(w[2] for w in want)
    same(queries.op13_suffix_dedup(spark, "/root/testdata/sf0.001").collect(), want)


def passages(seed, n=60):
    """Texts that share passages about as long as the window, near copies, texts of one sign and of short periods, and copies."""
    random = np.random.default_rng(seed)

    def noise(k):
        return "".join(random.choice(list("abcdefghé ☃"), k))

    common = [noise(k) for k in (38, 39, 40, 41, 80, 200)]
    out = []
    for i in range(n):
        parts = [noise(int(random.integers(0, 90))) for _ in range(4)]
        for p in random.choice(len(common), 2):
            parts.insert(int(random.integers(0, 5)), common[p])
        out.append("".join(parts))
    for i in range(12):
        own = list(out[0] + out[1])
        own[int(random.integers(0, len(own)))] = "X"
        out.append("".join(own))
    return [*out, "z" * 500, "zy" * 250 + "q", "zyx" * 30, "y" + "z" * 45, *out[:3], "", None]


@pytest.mark.parametrize("seed,length,block", [(1, 40, 16), (2, 40, 3), (3, 50, 1), (4, 7, 2)])
def test_small_windows(spark, seed, length, block):
    rows = [(i, t) for i, t in enumerate(passages(seed))]
    df = docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in rows])
    same(suffix_dedup.digest(df, length, block).collect(), brute(rows, length))


def test_odd_cases(spark):
    df = docs(spark).selectExpr("*", "n AS kept", "n AS K1")
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 400)
    same(suffix_dedup.digest(df).collect(), want)
    left = suffix_dedup.remove_repeats(df)
    assert left.columns == [*df.columns, "_kept"]
    assert Counter((r.doc_id, bytes(r["_kept"])) for r in left.collect()) == Counter((w[0], w[5]) for w in want)
    assert suffix_dedup.digest(df.where("false")).count() == 0
    assert suffix_dedup.digest(df.where("doc_id = 3")).count() == 1


def test_pieces_of_long_texts_agree(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    rows = [(i, t) for i, t in enumerate(passages(9, 30))]
    same(suffix_dedup.digest(docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in rows]), 40, 8).collect(), brute(rows, 40))


def test_spans_merge():
    spans = [suffix_dedup.packed(a, 0, n) for a, n in ((30, 2), (0, 1), (9, 1), (20, 1), (70, 1))]
    assert suffix_dedup.merged_runs(np.array(spans), 10).tolist() == [0, 19, 20, 41, 70, 80]
