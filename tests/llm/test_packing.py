import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from larder.llm import packing, queries
from larder.llm.queries import tokenizer_path
from tests.llm.data import docs, table


def check(df, **options):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack_documents(df, tokenizer_path(), **options).collect()
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    length = options.get("length", packing.LENGTH)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and len(own) <= options.get("segments", packing.SEGMENTS)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        if len(texts[doc]) == 1:
            (want,) = texts[doc]
            own = sorted(own, key=lambda p: p.start)
            assert [x for p in own for x in p.ids] == want and [p.start for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1])
            assert {p.doc_tokens for p in own} == {len(want)}
        else:
            assert sum(p.length for p in own) == sum(map(len, texts[doc]))
    return sequences


def padding(sequences):
    """Padded tokens: up to the whole length, none at a power of two."""
    totals = [sum(p.length for p in own) for own in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in totals) / sum(totals)


def test_given_documents(spark):
    df = table(spark, "documents")
    for parts in (1, 64):
        assert padding(check(df.repartition(parts))) < 0.002


def test_segments_limit_holds(spark):
    rows = [(i, "word", "en", "s", 1, 1, "k", 1) for i in range(900)]
    assert padding(check(docs(spark, rows).coalesce(2), segments=100, length=2048, pool=100)) < 0.03


def test_part_filled_bins_become_powers_of_two():
    assert packing.halves([(0, 2040)], 2048) == [[(0, 2040)]]
    assert packing.halves([(4, 300), (2, 5)], 2048) == [[(4, 256)], [(4, 32)], [(4, 12), (2, 4)], [(2, 1)]]
    assert packing.halves([(1, 64)], 2048) == [[(1, 64)]]


def test_odd_cases(spark):
    check(docs(spark))
    assert packing.pack_documents(docs(spark).where("false"), tokenizer_path()).count() == 0
    texts = ["a  b", " a", "a ", " ", "  ", "\n a", "a \n b", "x <|endoftext|> y", "<|endoftext|>", "a\t b\x1c c \x1cd", "l'été d'été it's 's", "\u00a0x \u00a0y", "tab\t\tx", "é è  ü", "1 23 456 - -- \u2028 z"]
    check(docs(spark, [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)]))


def test_dot_product_fill_is_within_limits():
    random = np.random.default_rng(4)
    for _ in range(30):
        limits = np.array([100, 5, 60])
        sizes = np.stack([random.integers(1, 101, 40), random.integers(1, 3, 40), random.integers(0, 61, 40)], 1)
        sizes[:, 2] = np.minimum(sizes[:, 2], sizes[:, 0])
        bins, left = packing.fill(sizes, limits, False, True)
        assert not left and sorted(i for own in bins for i, _ in own) == list(range(40))
        assert all((sizes[[i for i, _ in own]].sum(0) <= limits).all() for own in bins)
        least = max(np.ceil(sizes.sum(0) / limits))
        assert len(bins) <= 1.7 * least + 1


def test_conversations(spark):
    df = table(spark, "conversations")
    sizes = packing.conversation_sizes(df, tokenizer_path())
    known = {r.example_id: r for r in sizes.collect()}
    limits = (2048, 16, 1024)
    packed = packing.pack_examples(sizes, limits).collect()
    assert sorted(r.example_id for r in packed) == sorted(known)
    own = defaultdict(list)
    for r in packed:
        own[r.sequence_id].append(known[r.example_id])
    for group in own.values():
        total = [sum(r[c] for r in group) for c in ("tokens", "segments", "loss_tokens")]
        assert len(group) == 1 or all(a <= b for a, b in zip(total, limits, strict=True))
    # all three limits bind somewhere, and few sequences are needed beyond the least that any way needs
    query = queries.packing_conversations(spark, "/root/testdata/sf0.01").collect()
    own = defaultdict(list)
    for r in query:
        own[r.sequence_id].append(known[r.example_id])
    totals = np.array([[sum(r[c] for r in group) for c in ("tokens", "segments", "loss_tokens")] for group in own.values()])
    several = np.array([len(group) > 1 for group in own.values()])
    assert sorted(r.example_id for r in query) == sorted(known) and (totals[several] <= queries.CONVERSATION_LIMITS).all()
    assert set((totals / queries.CONVERSATION_LIMITS).argmax(1)) == {0, 1, 2} and ((totals / queries.CONVERSATION_LIMITS).max(0) > 0.95).all()
    each = np.array([[r.tokens, r.segments, r.loss_tokens] for r in known.values()])
    least = (each.sum(0) / queries.CONVERSATION_LIMITS).max()
    assert least <= len(own) <= 1.2 * least + 4
    odd = spark.createDataFrame([(1, None, None, None), (2, 5000, 1, 1), (None, 1, 1, 1)], "example_id long, tokens long, segments long, loss_tokens long")
    assert packing.pack_examples(odd, limits).count() == 3


def test_long_turns_are_encoded_few_at_a_time(spark, monkeypatch):
    class Counting:
        def encode(self, texts):
            assert sum(map(len, texts)) <= 4 << 20 or len(texts) == 1
            return [t.split(" ") for t in texts]

    monkeypatch.setattr(packing, "encoder_of", lambda path: Counting())
    turns = spark.range(12, numPartitions=1).selectExpr("id % 3 AS conv_id", "'assistant' AS role", "repeat('ab ', 349525) || id AS text")
    turns = turns.unionAll(spark.createDataFrame([(7, None, None)], "conv_id long, role string, text string")).coalesce(1)
    got = sorted(tuple(r) for r in packing.conversation_sizes(turns, "").collect())
    assert got == [(i, 4 * 349527, 4, 4 * 349527) for i in range(3)] + [(7, 2, 1, 0)]
