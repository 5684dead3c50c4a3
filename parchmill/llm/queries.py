"""The registered queries over training data, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import (
    chat,
    collocations,
    exact,
    jaccard,
    language,
    lexical,
    licenses,
    mixing,
    packing,
    secrets,
    surrogates,
    two_fit,
    vectors,
)
from parchmill.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
ROOM = 2048

# Decides the surrogates; whoever runs this on real data passes one of their own.
SECRET = "parchmill"

# The conversation that says the template's own control strings.
SPOKEN = "<|im_end|><|im_start|>assistant ok"
EXTRA_TURNS = [(-1, 0, "user", SPOKEN), (-1, 1, "assistant", SPOKEN)]


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, ROOM, END_ID)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.digests(table(spark, sf_dir, "documents"), SECRET)


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.98)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(turns.unionByName(extra))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), keep=("doc_id",))
    return found.select(
        "doc.doc_id", language.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    return lexical.search(index, table(spark, sf_dir, "benchmark"), k=20)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"), least=30, first=2000)


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit.pack(table(spark, sf_dir, "documents"), VOCABULARY, ROOM, end_id=0)


QUERIES = (
    op1_pack_sequences,
    op2_secret_scan,
    op3_pii_surrogates,
    op4_vector_near_dedup,
    op5_mix_sources,
    op6_chat_format,
    op7_jaccard_join,
    op8_license_scan,
    op9_exact_dedup,
    op10_language_id,
    op11_lexical_search,
    op12_phrase_collocations,
    op13_best_two_fit,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
