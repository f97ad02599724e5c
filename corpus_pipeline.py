"""From raw documents to training tokens: five stages, each written before the next reads it.

Each stage calls one operator of ``tallgrass.llm`` on all rows that the one before it kept.
In every stage a null text counts as an empty one, a row without id is judged by its text
alone, a very long text is handled whole, the order of rows and partitions makes no
difference, an empty table gives an empty one, and further columns, whatever their names,
pass through unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, decontaminate, line_templates, near_copies, quality_rules
from tallgrass.llm.shared import Table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy keeps; null and empty texts fail it, repeated rows are judged alike."""
    return quality_rules.filter_documents(docs, quality_rules.POLICIES["v1"])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates but in the first document of each.

    Repeated rows are one document and lose the same lines; a null text stays null.
    """
    return line_templates.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies (five-word shingles, similarity >= 0.8).

    Null and blank texts are one group; of repeated rows one stays; rows without id give way to rows with one.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none, repeated rows go or stay together."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether they decode to the text; none for a null or empty text."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), *bpe.public_vocabulary(), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokenize),
]

#: Fingerprints, templates by hash and token ids are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; a stage's table goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), name)
        if last is not None:
            last.drop()
        docs, last = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
