"""A corpus pipeline: five stages over ``documents``, each over all that the stage before kept.

Quality classifier, near-duplicates, benchmark decontamination, personal data,
encoding.  Between stages the rows are written as Parquet and read again.

Defined results: a null text counts as empty in every stage, and comes out of the
fourth one as empty; empty texts are scored by the classifier as any, are no near
copies, hold no benchmark item, and encode to no ids.  Rows without id go through
all stages; of equal rows with words one stays.  Of a group of near copies the row
with the least id stays, rows without id last, and among equal ids the one with
the least hash of id and text.  Columns beside the id and the text are handed on
as they are, whatever their names.  An empty table gives an empty result, and
without labels of both classes every document is kept by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalode.llm import bpe, decontamination, near_dup, pii, quality_classifier
from stratalode.llm.runtime import materialize, read_table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go."""
    return quality_classifier.keep(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, on five-word shingles at similarity 0.8: one document of each group stays."""
    return near_dup.drop_similar(docs, k=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents into which a benchmark item leaks go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal data is masked, disclosing terms generalised or removed."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the sanitised texts as ids, and what the ids decode to."""
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", accept_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", sanitise),
    ("bpe", encode),
]

#: No SQL: the classifier's descent, the co-occurrence blocks and the merges are not expressible; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
