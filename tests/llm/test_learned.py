import zlib

import numpy as np
import pytest

from larder.llm import quality_cnn, toxicity
from larder.llm.labelled import training_rows
from tests.llm.data import docs, table

LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("module", "label", "least_auc", "least_right"), [(toxicity, "toxic", 0.95, 0.98), (quality_cnn, "quality", 0.95, 0.93)])
def test_held_out_accuracy(spark, module, label, least_auc, least_right):
    df, labels = table(spark, "documents", LARGE), table(spark, "labels", LARGE)
    model = module.learn(df, labels)
    got = module.score_documents(df, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"])
    known = got[label].to_numpy()
    assert auc(got["score"].to_numpy(), known) > least_auc
    assert (got["predicted"] == known).mean() > least_right
    assert got["score"].between(0, 1).all()


def test_held_out_labels_teach_nothing(spark):
    df, labels = table(spark, "documents"), table(spark, "labels")
    rows = training_rows(df, labels, "toxic", 10**6)
    kept = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert rows.count() == len(kept) and set(rows.columns) == {"text", "label"}
    assert training_rows(df, labels, "toxic", 7).count() == 7


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_odd_cases(spark, module):
    df, labels = docs(spark), table(spark, "labels")
    none = labels.where("false")
    model = module.learn(df, none)
    got = module.score_documents(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    model = module.learn(table(spark, "documents"), labels)
    got = module.score_documents(df, model).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert module.score_documents(df.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 7, 7), (4, 1, 0), (4, 0, 1), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score_documents(df, module.learn(df, odd)).collect())


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " clown": 4.0, " trash ": 3.0})
    plain = lexicon.found("What an idiot, truly.")
    assert plain == (5.0, 4)
    for spelled in ("1d10t", "IDIOT!!", "іdіоt", "i​diot", "ｉｄｉｏｔ", "id!ot idiot"):
        assert lexicon.found(spelled)[0] == 5.0, spelled
    assert lexicon.found("the clown fish by the trash can")[0] == 0
    assert lexicon.found("the clown by the trash")[0] == 7.0
    assert lexicon.score("idiot " * 3) > lexicon.score("idiot " * 3 + "word " * 3000)
    assert toxicity.Lexicon({}).found("idiot")[0] == 0


def test_aho_corasick_equals_looking_everywhere():
    random = np.random.default_rng(2)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc ": 2.0, " ca": 3.0, " b ": 4.0}, ("ab ca",))
    for _ in range(300):
        text = " ".join("".join(random.choice(list("abc"), random.integers(1, 4))) for _ in range(12))
        flat = toxicity.folded(text)
        hidden = [(k, k + 6) for k in range(len(flat)) if flat.startswith(" ab ca ", k)]
        best = {}
        for entry, weight in lexicon.weights.items():
            for k in range(len(flat)):
                if flat.startswith(entry, k) and not any(a <= k < b for a, b in hidden):
                    best[k] = max(best.get(k, 0), weight)
        assert lexicon.found(text) == (sum(best.values()), 12)


def test_training_rows_are_drawn_whole(spark, monkeypatch):
    """All chunks of each text, and whole texts as long as they fit."""
    rows = spark.createDataFrame([(f"{i} " * (200 * i + 1), i % 2) for i in range(12)] + [("3 " * 601, 1)], "text string, label int")
    sample = quality_cnn._sample(rows)
    size = quality_cnn.CELL * quality_cnn.CHUNK + quality_cnn.WIDTH - 1
    assert sample["row"].nunique() == 12
    for text in ("11 " * 2201, "0 "):
        data = quality_cnn.padded(np.frombuffer(text.encode(), np.uint8))
        starts = range(0, max(1, len(data) - size + quality_cnn.CELL * quality_cnn.STRIDE), quality_cnn.CELL * quality_cnn.STRIDE)
        chunks = [data[s : s + size].tobytes() for s in starts]
        assert any(sorted(own["chunk"]) == sorted(chunks) for _, own in sample.groupby("row"))
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 16_000)
    few = quality_cnn._sample(rows)
    assert 0 < few["row"].nunique() < 5 and set(few["row"]) <= set(sample["row"])


def test_few_labels_still_teach(spark):
    """A word in three toxic texts of ten is enough, and clean texts stay clean."""
    words = "the of and to in for on with as by".split()
    say = lambda i, *more: " ".join([*(words[(i * k) % 10] for k in range(3, 9)), *more])
    texts = [(i, say(i, "nitwit"), 1) for i in range(60, 75)] + [(i, say(i), 0) for i in range(100, 220)]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    got = toxicity.score_documents(df, toxicity.learn(df, labels)).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got) and any(r.held_out and r.toxic for r in got)


def test_network_covers_the_whole_text():
    network = quality_cnn.constant(0.5)
    network.taps[0, ord("#"), 0] = 5.0
    network.out[quality_cnn.FILTERS] = -2.0
    plain = quality_cnn.Network.score
    for at in (0, 63, 4000, 70_000, 150_000):
        text = bytearray(b"a" * 160_000)
        text[at] = ord("#")
        assert plain(network, np.frombuffer(bytes(text), np.uint8)) < 0.01, at
    assert plain(network, np.zeros(0, np.uint8)) == 0.5


def test_tables_equal_a_plain_convolution():
    random = np.random.default_rng(0)
    network = quality_cnn.Network(random.normal(size=(quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), random.normal(size=quality_cnn.FILTERS), np.zeros(2 * quality_cnn.FILTERS), 0.0)
    data = random.integers(0, 256, 1000).astype(np.uint8)
    n = len(data) - quality_cnn.WIDTH + 1
    whole = np.stack([sum(network.taps[k][data[i + k]] for k in range(quality_cnn.WIDTH)) for i in range(n)]) + network.bias
    cells = np.stack([np.maximum(whole[a : a + quality_cnn.CELL].max(0), 0) for a in range(0, n, quality_cnn.CELL)])
    assert np.allclose(network.cells(data), cells, atol=1e-4)
