"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it back for
the next.

Rejected by the quality rules: gone.  Exact copies: the smallest doc_id stays.
Near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id
of a group stays.  Mixing: a document stays as often as the mix takes it, up to
twice.  Packing: every copy is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, mixing, near_dedup, packing, quality
from tessella.llm.common import stage, table
from tessella.llm.tokens import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the learned rules nor the packing: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
