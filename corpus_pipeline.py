"""A corpus pipeline of five stages: language ID, near-dedup, suffix-array dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``docs``, extra ones too. Rows with null doc_id can't be named by a decision and leave at the second stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriglyph.llm import decontamination, language_id, minhash_dedup, sentencepiece_codec, suffix_dedup
from veriglyph.llm.durable import cut, tidy


def _alone(stage):
    """A stage begins without the shuffles that only its predecessors needed."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return run


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: null and letterless texts and those whose n-grams no learnt language has go; very short ones get the benefit of the doubt."""
    names = docs.columns
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model, names, resemblance=True).toDF(*[f"c{k}" for k in range(len(names))], "label_", "score_", "resembles_")
    return found.filter((F.col("label_") != "und") & F.col("resembles_")).drop("label_", "score_", "resembles_").toDF(*names)


def _keyed(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text, with ``key_``: its own number, in the order of doc_id. Without repeated doc_ids, doc_id itself."""
    docs = docs.filter("doc_id is not null").withColumn("key_", F.col("doc_id").cast("long"))
    if docs.groupBy("key_").count().filter("count > 1").isEmpty():
        return docs
    docs = docs.withColumn("version_", F.xxhash64("text"))
    order = docs.select("key_", "version_").distinct().repartitionByRange("key_", "version_").sortWithinPartitions("key_", "version_")
    order = cut(order.withColumn("number_", F.monotonically_increasing_id()))
    single = docs.dropDuplicates(["key_", "version_"]).join(order, ["key_", "version_"])
    return cut(single.drop("key_", "version_").withColumnRenamed("number_", "key_"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component one document of the smallest doc_id stays; texts that share a doc_id are documents each."""
    docs = _keyed(docs)
    kept = minhash_dedup.near_components(docs.select(F.col("key_").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("kept_"))
    return docs.join(kept, docs["key_"] == kept["kept_"], "left_semi").drop("key_")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later copies of 100 bytes or more leave the texts, whole characters at a time."""
    names, docs = docs.columns, _keyed(docs)
    left = suffix_dedup.removed_bytes(docs.select(F.col("key_").alias("doc_id"), "text"), texts=True).select(F.col("doc_id").alias("id_"), F.col("text").alias("left_"))
    rest = docs.drop("text")
    joined = rest.join(left, rest["key_"] == left["id_"])
    new = {"text": F.col("left_"), "n_chars": F.char_length("left_").cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else rest[c] for c in names])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: contaminated documents go."""
    judged = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("id_"), F.col("version").alias("version_")).distinct()
    return docs.join(bad, (docs["doc_id"].cast("long") == bad["id_"]) & (F.xxhash64(docs["text"]) == bad["version_"]), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents with their ids and their number."""
    coded = sentencepiece_codec.tokenize(docs, ids="ids")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify),
    ("near_dedup", _alone(near_dedup)),
    ("exact_dedup", _alone(exact_dedup)),
    ("decontaminate", _alone(decontaminate)),
    ("tokenize", _alone(tokenize)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
