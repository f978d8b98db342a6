"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of the documents. The stages learn and replace text, so no SQL statement gives their rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.llm import decontaminate as _decontaminate
from domainforge.llm import jaccard_join, packing, quality, sanitise
from domainforge.plans.scratch import materialize, release_shuffles


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, name="_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document that names it; of repeated rows one."""
    rows = jaccard_join.similarity_components(docs).groupBy("doc_id").agg(F.count("*").alias("_rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_named"))
    named = materialize(rows.where("_named").select(F.col("doc_id").alias("_kept"), "_rows"), "named")
    release_shuffles(spark)

    def of(some: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        """The texts are dealt once and not sorted: the ids of a part are hashed."""
        return some.join(ids.select("_kept").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept")), how)

    again = named.where("_rows > 1")
    if again.isEmpty():
        return of(docs, named, "left_semi")
    return of(docs, named.where("_rows = 1"), "left_semi").unionByName(of(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = _decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("_items") == 0).select(*docs.columns)


def sanitise_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms taken out of their texts."""
    found = sanitise.find_private(docs)
    touched = (F.size("_base") + F.size("_added")) > 0
    text = F.when(touched, sanitise.sanitised(F.col("text"), F.col("_base"), F.col("_added"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal data", sanitise_text),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
