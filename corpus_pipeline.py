"""A training-corpus pipeline over ``documents``; each stage's result is written and read again as the next one's input.

In every stage rows without doc_id go (no verdict can name them), repeated rows are judged alike, texts of any length
are taken whole, an empty table gives an empty result, and columns of any other name pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docops.llm.best_fit import packed
from docops.llm.decontaminate import contaminated
from docops.llm.ngram_join import linked
from docops.llm.quality_lm import quality
from docops.llm.shared import stored
from docops.llm.suffix_dedup import stripped


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``gone``, columns as they are."""
    return docs.where("doc_id IS NOT NULL").join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; null and empty texts are rejected."""
    verdicts = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, verdicts.where("NOT kept"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8, the one of smallest doc_id stays.

    Null, empty and blank texts are linked with nothing and stay; of repeated rows of that doc_id all stay.
    """
    return _without(docs, linked(docs, k=5, percent=80).where("doc_id <> component_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus are cut from the texts; texts left without a word go.

    Null, empty and blank texts have no word; of repeated rows of one doc_id the later lose what the first keeps.
    """
    left = stripped(docs)
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go; null and empty texts stay."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left is packed into training sequences; a text without words is a piece in no bin."""
    return packed(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The quality model and the packing have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
