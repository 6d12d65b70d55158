"""The corpus pipeline: five stages over ``documents``, each an operator of finstmt.llm.

Every stage reads what its predecessor wrote. All but the last return the columns of documents. Results are gathered
into partitions by the number of documents, so that a shuffle of many small partitions isn't written as many small files.

Cases, for all stages: extra columns, whatever their names, are kept up to packing and never read; very long texts
are read whole; an empty table gives an empty one. What each does with nulls, ties and repeated rows is its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finstmt.llm import decontaminate, near_dup, packing, pii, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have no toxic word and stay; each row is judged alone."""
    return shared.gathered(toxicity.without_toxic(docs, shared.table(spark, sf_dir, "labels")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id, null last, then of the
    smallest text hash. Texts without words are near nothing; of these only repeated rows go."""
    return shared.gathered(near_dup.one_of_each(docs), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a text of nothing else becomes a few signs or empty. Nulls stay null, no row goes."""
    return shared.gathered(decontaminate.remove_spans(docs, shared.table(spark, sf_dir, "benchmark")), docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; nulls stay null, no row goes, repeated rows change alike."""
    return shared.gathered(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as pieces of token sequences; a null or empty text is one piece of one id. Ties on the curve
    stand in the order of rows."""
    return shared.gathered(packing.pack(docs), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Learning, near-duplicates and tokens are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = shared.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
