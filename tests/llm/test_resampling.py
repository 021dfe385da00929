"""Importance resampling against counts of every feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import queries, resampling
from tests.llm.data import docs, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(rows, target, percent, least, seed, buckets):
    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])

    s, t = totals(t for _, t in rows), totals(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        w, f = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in (zlib.crc32(x.encode()) % buckets for x in f))
        weight = gain // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = brute(rows, [r.text for r in table(spark, "benchmark").collect()], 25, 20, 7, 10_000)
    got = queries.op12_resampling(spark, "/root/testdata/sf0.01").select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("nodes", [1 << 20, 50])
def test_odd_cases(spark, monkeypatch, nodes):
    monkeypatch.setattr(resampling, "PIECE", 5000)
    monkeypatch.setattr(resampling, "NODES", nodes)
    df = docs(spark)
    target = docs(spark, [(1, "The quick brown fox, again and again", *[None] * 6), (2, None, *[None] * 6)]).select("text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, [r.text for r in target.collect()], 50, 2, 3, 500)
    got = resampling.resample(df, target, 50, 2, 3, 500).collect()

    def bare(rows):  # which of several equal rows gets which rank isn't defined
        return Counter(tuple(r)[:4] for r in rows), sorted(r[4] for r in rows if r[4] is not None)

    assert bare(got) == bare(want)
    assert sorted((r.rank, r.doc_id) for r in got if r.rank) == sorted((w[4], w[0]) for w in want if w[4])
    assert resampling.resample(df.where("false"), target).count() == 0
    assert resampling.resample(df, target.where("false"), 100, 1).where("rank is not null").count() == sum(r[0] is not None and bool(features(r[1])[0]) for r in rows)


def test_crc_states_carry_on():
    random = np.random.default_rng(2)
    shifts = resampling.Shifts()
    parts = [(random.bytes(int(a)), random.bytes(int(b))) for a, b in random.integers(0, 300, (200, 2))]
    state = shifts.carried(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert (state ^ np.array([zlib.crc32(b) for _, b in parts], np.uint32)).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_words_hash_like_crc32():
    texts = ["", "a", "Hello, WORLD 42 " + "x" * 200, "  ☃é  b", "end", "start"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, n = resampling.words_of(raw, offsets)
    want = [WORD.findall(t.translate(LOWER)) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert [(w & 0xFFFFFFFF, w >> 32) for w in words.tolist()] == [(zlib.crc32(x.encode()), len(x.encode())) for w in want for x in w]
