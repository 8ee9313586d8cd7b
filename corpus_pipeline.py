"""A training corpus from ``documents``: identify, deduplicate, decontaminate, pack.

``STAGES`` are (name, function) in order.  Each function takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` applies them to the whole table, each on what its
predecessor kept, written as Parquet in between.

Every stage keeps extra columns, stands nulls in any column and an empty
table, and treats a repeated row as a copy:

- ``language``: texts that are null, without letters, or strange to every
  learned language go.  Learned is from the rows of ``docs`` that the
  operator's fold allows.
- ``near_duplicates``: one document of each SimHash group stays, the one with
  the smallest id.
- ``repeated_passages``: bytes of passages that also start anywhere else go;
  a character that is cut goes too.  A document that loses all its text goes.
- ``decontamination``: contaminated documents go; in the others the words of
  benchmark windows go.
- ``packing``: one row per piece, with its sequence and its place there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.columns import table
from keepwell.llm.decontam import clean
from keepwell.llm.language import learn, recognised, training_rows
from keepwell.llm.packing import op2
from keepwell.llm.simhash import one_per_group
from keepwell.llm.suffix_dedup import without_repeated
from keepwell.session import ensure_checkpoint_dir


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised(docs, learn(training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(without_repeated(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(clean(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL has no suffix automata, XXH64 or byte-level BPE; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    shared = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{shared}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{shared}/{name}")
    return docs
