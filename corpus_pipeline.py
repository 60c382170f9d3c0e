"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import op3_line_dedup, op6_langid, op7_packing, op8_minhash, op10_decontaminate
from lexiloom.llm.common import cut, table

#: No stage's method can be written in SQL; tests/llm/test_pipeline.py holds the stages, one by one, against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (`_gone`); rows with a null doc_id stay."""
    return docs.join(ids, F.col("doc_id") == F.col("_gone"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text shows no language go: no letter, or too few of its n-grams in the filter of any
    language. The filters are fitted on two thirds of the documents' own labels, the bars on the rest; without any labelled text all documents with a letter stay."""
    rest = op6_langid.held_out("doc_id", 3, 1)
    filters, _ = op6_langid.fit(docs.where(~rest).select(F.col("doc_id").alias("id"), "text", "lang"))
    return op6_langid.with_language(docs, filters, op6_langid.bars(docs.where(rest), filters))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go; documents of nothing else go with them."""
    out = op3_line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    marked = op8_minhash.near_duplicates(docs)
    gone = marked.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return _without(docs, cut(gone, "pl-near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = op10_decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, cut(found.select(F.col("doc_id").alias("_gone")).distinct(), "pl-leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in full windows of 4096 tokens."""
    return op7_packing.pack(docs, op7_packing.default_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pl-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
