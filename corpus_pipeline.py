"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents, whatever other columns these have.

Defined cases, for every stage: an empty table gives an empty result; a null text counts as empty and stays null; null ids
are ids like others, and the smallest; very long texts are read whole; ids must be whole numbers. Repeated rows: the
classifier judges each for itself, near-duplicates keep one (of texts without words all), the other stages treat each for
itself. Ties in a label between two rows of one id both teach. Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import attention_mil, decontaminate, minhash, packing, suffix_dedup
from loomframe.llm.common import fold, fresh, stored, table

#: Bytes that a passage must repeat to be removed: about twenty words.
PASSAGE_BYTES = 100
#: Documents below this score go.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled rows outside fold 0."""
    model = attention_mil.train(docs, table(spark, sf_dir, "labels"), fold() != 0)
    name = fresh(docs.columns, "score")
    return attention_mil.score(docs, model, name).filter(F.col(name) >= QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by 0.8 of their 5-word shingles."""
    return minhash.one_of_each(docs, size=5)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has too; n_chars follows the text."""
    done = suffix_dedup.repeats(docs, PASSAGE_BYTES, whole_characters=True)
    text = F.when(F.col("removed") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("removed") > 0, F.char_length(text).cast(kind)).otherwise(F.col("row.n_chars"))
    return done.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
