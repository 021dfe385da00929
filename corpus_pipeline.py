"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of ``documents``:

1. toxicity: rows whose text is toxic go;
2. near_dedup: of each group of near copies (five-word shingles, similarity of 0.8 or more) one row stays;
3. secrets: reported spans are replaced in the text;
4. mixing: each leaf of the domain-language-source tree gives the seeded prefix that its budget allows;
5. packing: texts become pieces of token sequences.

Empty tables, nulls in any column and repeated rows pass through every stage as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import minhash, mixing, packing, secrets, toxicity
from larder.llm.common import checkpoint, read
from larder.llm.queries import tokenizer_path

#: Share of the tokens that the mixture takes, and weights of its leaves; no leaf gives more than one epoch.
MIX_TOTAL, MIX_WEIGHTS, MIX_SEED = 0.9, {"domain0": 2.0}, 29
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_TOTAL, MIX_WEIGHTS, max_epochs=1, seed=MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express a learned lexicon or a tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
