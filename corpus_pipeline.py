"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a written table, and returns the documents it keeps with their columns; the
last returns the packed pieces. A stage's result is written to the shared folder, so a lost executor repeats one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import packing, pii
from seriesloom.llm.decontaminate import contamination
from seriesloom.llm.near_dedup import near_components
from seriesloom.llm.quality_rules import quality
from seriesloom.llm.tables import stored

#: Packing numbers its sequences freely and the redaction model is fitted; SQL has no words for either.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality(docs).where("quality.kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (words by five, similarity 0.8), one with the smallest id.

    Documents without words or without an id stay. Rows are told apart by id and text.
    """
    found = near_components(docs, width=5)
    alone = found.where("group IS NULL OR doc_id IS NULL").select("doc_id", "text_key")
    first = found.where("group IS NOT NULL AND kept AND doc_id IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    rows = docs.withColumn("_key", F.xxhash64("text"))
    kept = first.select(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_text"))
    one = rows.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_text")), "left_semi")
    alone = alone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct()
    rest = rows.join(alone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left_semi")
    return one.dropDuplicates(["doc_id", "_key"]).unionByName(rest).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten words in a row of a benchmark item, or a shorter item whole.

    Documents without an id, should there be any, are told apart by a hash of their text meanwhile.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def clean(rows: DataFrame) -> DataFrame:
        found = contamination(rows, benchmark).where("contaminated").select("doc_id")
        return rows.join(found, "doc_id", "left_anti").select(*docs.columns)

    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return clean(docs)
    kept = clean(nameless.withColumn("doc_id", F.xxhash64("text"))).withColumn("doc_id", F.lit(None).cast("long"))
    return clean(docs.where("doc_id IS NOT NULL")).unionByName(kept)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    found = pii.spans(docs, pii.fit(docs))
    text = pii.redacted(F.col("text"), F.col("pii.all"))
    out = found.withColumn("text", F.when(F.size("pii.all") > 0, text).otherwise(F.col("text")))
    changed = F.size("pii.all") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what is too long and pack all into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
