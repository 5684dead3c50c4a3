"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before
it kept, read from the table that one wrote. All but the last return the columns
of documents. An empty table gives an empty one at every stage; nulls, repeated
rows and extra columns follow the rules of each stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmill.llm import exact, jaccard, language, mixing, packing
from parchmill.llm.common import small_batches, staged, table
from parchmill.llm.queries import END_ID, ROOM, VOCABULARY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those far from every language, go."""
    small_batches(spark)
    found = language.identify(docs, language.fit(docs))
    return found.filter("not rejected").select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space one row stays, that of the smallest doc_id."""
    return exact.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a similarity of 0.8 of their five-word shingles connects, one stays."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document; the last one of a source may be cut at its target."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs, VOCABULARY, ROOM, END_ID)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# The first and last stage learn from texts and use a vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
