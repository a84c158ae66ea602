"""From raw documents to packed training windows: five stages, each a DataFrame job over all that its predecessor kept.

Every stage takes null columns, empty and very long texts, ties, rows that repeat and an empty table, and returns the
columns of its documents (the last one those of `packing.packed`); further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, packing, pii, simhash
from ledgerloom.llm.common import written


#: Rows that go to a Python worker at once. Texts are long: Spark's usual 10,000 hold tens of megabytes, in the executor and
#: in each of its workers, which live on from stage to stage.
ROWS = 1000
#: Bytes of a Parquet row group, which a task holds in the heap until it is full; 128 MB are usual.
GROUP = 8 << 20


def _lean(spark: SparkSession) -> None:
    """Batches of few rows, to a Python worker and from a Parquet file, and small row groups: arrays of many megabytes make an
    executor's heap grow, and it does not shrink again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS)
    spark.conf.set("parquet.block.size", GROUP)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or with one by too narrow a margin: null texts and those without letters, too. Rows
    that repeat stay or go together; where no row is labelled none has a language, and none stays."""
    _lean(spark)
    return language_id.identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id: of rows that repeat one, of null and
    empty texts one. Rows without a doc_id stay."""
    _lean(spark)
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages contaminate. Null and empty texts are clean; without items all rows stay."""
    _lean(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes personal data and the words that disclose it out of the texts. All rows stay; null texts stay null."""
    _lean(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in windows of tokens: every row, a null or empty text as its end alone."""
    _lean(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the compression classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
