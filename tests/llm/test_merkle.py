import hashlib

from pyspark.sql import functions as F

from larder.llm import merkle
from tests.llm.data import docs, table


def check(df, rows=merkle.BUCKET_ROWS):
    texts = sorted((r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None)
    every = merkle.compare_with_edits(df, rows).collect()
    bare = sorted(r.text or "" for r in df.collect() if r.doc_id is None)  # followed by themselves
    own = [t[: len(t) - len(t) // 2] + t[: len(t) // 2] for t in bare]
    assert sorted((len(t), hashlib.sha256(e.encode()).hexdigest(), 1.0) for t, e in zip(bare, own, strict=True)) == sorted((r.n_chars, r.edited_sha256, r.near_next) for r in every if r.doc_id is None)
    got = sorted((r for r in every if r.doc_id is not None), key=lambda r: (r.doc_id, r.n_chars, r.edited_sha256))
    assert len(every) == df.count()
    want, prints = [], {}
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        prints[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] = (t, edited)
    assert sorted(want) == [(r.doc_id, r.n_chars, r.edited_sha256) for r in got]
    by_text = {}
    for r in got:
        t, e = prints[(r.doc_id, r.n_chars, r.edited_sha256)]
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and by_text.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1) == (t == e)
        if t != e:
            same = next((k for k, (a, b) in enumerate(zip(t, e, strict=False)) if a != b), min(len(t), len(e)))
            assert r.first_difference <= same < r.first_difference + merkle.LEAF + 1
    assert len(set(by_text.values())) == len(by_text)
    return got


def test_given_documents(spark):
    got = check(table(spark, "documents"))
    longer = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in longer) > 0.95 * len(longer)


def test_buckets_agree(spark):
    df = table(spark, "documents", "/root/testdata/sf0.001")
    one = {r.doc_id: r for r in check(df)}
    assert {r.doc_id: r for r in check(df, rows=9)} == one


def test_odd_cases(spark):
    check(docs(spark))
    one = docs(spark, [(5, "abc def. ghi", "en", "s", 1, 1, "k", 1)])
    assert merkle.compare_with_edits(one).first().near_next == 1.0
    assert merkle.compare_with_edits(one.where("false")).count() == 0
    assert merkle.fingerprints(docs(spark)).count() == docs(spark).count()


def edits(spark, old, new):
    df = spark.createDataFrame([(old, new)], "a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "a"), "b", "b").withColumn("edits", merkle.differences("a", "b"))
    row = df.select("edits", F.transform("edits", lambda e: merkle.place_of("a", e)).alias("places")).first()
    return [tuple(e) for e in row.edits], row.places


def test_branches_name_the_edits(spark):
    """Edits are found in their leaf, paragraph or section, however much comes after them."""
    paragraphs = [[f"Sentence {i}.{j} says one thing. It says another. And a third.\n" for j in range(4)] for i in range(5)]
    whole = "\n".join("".join(p) for p in paragraphs)
    assert edits(spark, whole, whole) == ([], [])
    at = whole.index("Sentence 2.1")
    inserted = whole[:at] + "A new one stands here." + whole[at:]
    assert edits(spark, whole, inserted) == ([(2, 1, 0, 0, 1)], [at])
    changed = whole.replace("Sentence 1.3", "Sentence x.3").replace("Sentence 3.0", "Sentence y.0")
    assert edits(spark, whole, changed) == ([(1, 3, 0, 1, 1), (3, 0, 0, 1, 1)], [whole.index("Sentence 1.3"), whole.index("Sentence 3.0")])
    line = "Sentence 4.2 says one thing. It says another. And a third.\n"
    assert edits(spark, whole, whole.replace(line, "")) == ([(4, 2, None, 1, 0)], [whole.index(line)])
    assert edits(spark, whole, "First section.\n\n" + whole) == ([(0, None, None, 0, 1)], [0])
    assert edits(spark, "", "some text") == ([(0, 0, 0, 0, 1)], [0])


def test_leaves_lose_nothing(spark):
    texts = ["a\n\n\nb\n\nc. d! e?\n", "x" * 1000, "", ".\n.\n\n", "  lead. trail  \n\n\n\n"]
    rows = [(i, t, "en", "s", 1, 1, "k", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in merkle.fingerprints(docs(spark, rows)).collect()}
    assert [sum(s.n for s in got[i].tree) for i in range(5)] == [len(t) for t in texts]
    assert [sum(x.n for s in got[i].tree for p in s.paragraphs for x in p.leaves) for i in range(5)] == [len(t) for t in texts]
