"""A corpus in five stages: each reads what its predecessor kept and hands on what it keeps.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All
but the last return the columns of `docs`; the last replaces nothing and adds the pieces of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.llm import quality_classifier, quality_rules, sentencepiece_codec
from fleetsift.llm.common import shared_folder, table
from fleetsift.llm.mixing import mix
from fleetsift.llm.ngram_join import jaccard_join, one_of_each
from fleetsift.llm.queries import TOKENIZER

#: No SQL says what the trained stages keep; the stages are tested against plain versions instead.
ORACLE_SQL = None


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least a half."""
    model = quality_classifier.train(docs, quality_classifier.grades(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model, level=2, keep_columns=True)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    own = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]
    judged = quality_rules.judge(docs.select(*own, F.col("text").alias("_judged")), rules, "_judged")
    return judged.where("kept").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs, jaccard_join(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that meets the target weights of sources, languages and topics."""
    kept = mix(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their texts, with the ids of their pieces and whether these read as the text again."""
    model = sentencepiece_codec.load_model(spark, TOKENIZER)
    return sentencepiece_codec.encode(docs, model, checked_col="round_trip").drop("text")


STAGES = [("quality_classifier", classified), ("quality_rules", ruled), ("near_duplicates", deduplicated),
          ("mixing", mixed), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
