"""The corpus pipeline: documents through five operators, each stage's rows written as Parquet and read as the next one's input.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, quality_model, secret_scan, simhash
from lodestone.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality_model.judge_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays."""
    return simhash.keep_one(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat(F.struct(*COLUMNS), F.col("copies").cast("int"))).alias("d")).select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and offset of each."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality_classifier", classify), ("near_duplicates", deduplicate), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the classifier, fingerprints, random rounding nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
