"""Each stage of the pipeline against a brute-force version on what the stage before it kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import mixing, toxicity
from larder.llm.queries import tokenizer_path
from tests.llm.data import SF, SMALL, docs, table
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets import base_spans, linked_spans


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def redacted(text):
    if text is None:
        return None
    base = base_spans(text)
    out, at = "", 0
    for start, _, stop in sorted(base + linked_spans(text, base)):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, stop)
    return out + text[at:]


def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    now = table(spark, "documents")
    columns, kept = now.columns, {"documents": now}
    for name, stage in list(stages.items())[:-1]:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns

    lexicon = toxicity.learn(kept["documents"], table(spark, "labels"))
    want = Counter({k: n for k, n in rows_of(kept["documents"]).items() if lexicon.score(k[1] or "") < 0.5})
    assert rows_of(kept["toxicity"]) == want and sum(want.values()) < kept["documents"].count()

    rows = kept["toxicity"].collect()
    near = near_brute([(r.doc_id, r.text) for r in rows], corpus_pipeline.NEAR_PERCENT)
    assert rows_of(kept["near_dedup"]) == Counter(tuple(r) for r in rows if near[r.doc_id][1] == r.doc_id)
    assert kept["near_dedup"].count() < len(rows)

    want = Counter((r.doc_id, redacted(r.text), r.lang, r.source, len(redacted(r.text))) if redacted(r.text) != r.text else tuple(r) for r in kept["near_dedup"].collect())
    assert rows_of(kept["secrets"]) == want and kept["secrets"].where("text like '%[SECRET]%'").count() > 0

    rows = kept["secrets"].collect()
    copies = {r[0]: r[-1] for r in mix_brute(rows, corpus_pipeline.MIX_TOTAL, corpus_pipeline.MIX_WEIGHTS, 1, corpus_pipeline.MIX_SEED)}
    assert rows_of(kept["mixing"]) == Counter(tuple(r) for r in rows if copies[r.doc_id])

    check_packing(kept["mixing"])
    pieces = stages["packing"](spark, now, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in now.collect()}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert tokenizer_path().endswith(".json")


def test_odd_cases(spark):
    for rows in (docs(spark), docs(spark).where("false")):
        now = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SMALL)
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()]
        assert bool(ids) == (rows.count() > 0)


CLASHES = ("_id", "_hash", "_spans", "_gone", "id", "gone", "leaf_domain", "leaf_lang", "leaf_cut", "leaf_tokens", "_leaf_lang", "of_lang", "_tokens", "_lang", "_copies", "_copy", "copy", "key", "bucket", "component", "base", "linked", "LEAF_COPIES", "a.b", "n", "items")


def test_clashing_columns_go_through_unchanged(spark):
    """Every stage gives the rows it gives without them, and their values stay."""
    plain = docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        less, more = stage(spark, plain, SMALL), stage(spark, wide, SMALL)
        if name == "packing":
            assert rows_of(less.select("doc_id", "start", "length", "ids_crc32")) == rows_of(more.select("doc_id", "start", "length", "ids_crc32"))
            continue
        assert more.columns == [*less.columns, *CLASHES]
        got = more.collect()
        assert Counter(tuple(r)[:5] for r in got) == rows_of(less), name
        assert all(tuple(r)[5:] == tuple(f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in CLASHES) for r in got), name
    twice = mixing.mix(wide, 2.0, {}, 3, 1)
    assert twice.columns == wide.columns and twice.count() == mixing.mix(plain, 2.0, {}, 3, 1).count()
