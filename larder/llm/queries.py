"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import conversations, embedding_dedup, licenses, merkle, minhash, mixing, packing, quality_cnn, resampling, secrets, suffix_dedup, toxicity, url_filter
from larder.llm.common import read

#: Target weights of the mixing query: other paths weigh 1.
MIX_WEIGHTS = {"domain0": 3.0, "domain1": 2.0, "domain0/en": 2.0, "domain1/de/src5": 4.0}
MIX_TOTAL, MIX_EPOCHS, MIX_SEED = 0.8, 4, 17
TOKENIZER = "byte_bpe_50k.json"
#: Tokens, turns and loss-bearing tokens of a sequence of conversations.
CONVERSATION_LIMITS = (4096, 20, 3200)
#: Percent of the documents drawn, words that one needs at least, and seed of the importance resampling.
DRAW = (25, 20, 7)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(read(spark, sf_dir, "documents"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_cnn.score_documents(docs, quality_cnn.learn(docs, read(spark, sf_dir, "labels")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"), MIX_TOTAL, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of instruction data: whole conversations under limits on tokens, turns and tokens that bear loss."""
    sizes = packing.conversation_sizes(read(spark, sf_dir, "conversations"), tokenizer_path())
    return packing.pack_examples(sizes, CONVERSATION_LIMITS)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(given), given)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), *DRAW)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_secrets, op3_merkle, op4_quality_cnn, op5_minhash_dedup, op6_mixing, op7_packing, packing_conversations, op8_licenses, op9_url_filter, op10_toxicity, op11_conversation_repair, op12_resampling, op13_suffix_dedup)}

ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op5_minhash_dedup": minhash.oracle(85),
    "op6_mixing": mixing.oracle(MIX_TOTAL, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED),
    "op9_url_filter": url_filter.ORACLE,
    "op12_resampling": resampling.oracle(*DRAW),
}
