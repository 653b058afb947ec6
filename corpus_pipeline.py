"""A corpus pipeline over documents: toxicity, near duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import budget_mix, decontaminate, kd_shards, simhash_bytes, toxic_cnn
from rankloom.llm.common import new_path

#: SQL cannot express the classifier's training nor the seeded choices; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row, nulls included: what tells rows apart whose doc_id does not."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _whole(docs: DataFrame, rid: Column) -> DataFrame:
    """docs as one struct column row, so that no input column's name can clash with an operator's, and its identity rid."""
    return docs.select(rid.alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not flag at the threshold of their language; all columns of docs, rows unchanged.

    The model is fitted on all documents that labels covers. Null and empty texts are scored like others; empty docs stay empty.
    """
    model = toxic_cnn.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    scored = toxic_cnn.score(docs, model).where(~F.col("flagged"))
    return scored.select(*[F.col(f"row.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles at a similarity of 0.8 or more: the smallest doc_id's.

    Of rows that repeat a kept doc_id one stays. Rows with a null doc_id stay, of wholly equal ones one. Null, empty and blank
    texts are one group.
    """
    keep = simhash_bytes.similar_groups(docs, words=5, similarity=0.8).where("doc_id = component_id")
    n = keep.groupBy(F.col("doc_id").alias("keep_id")).agg(F.count("*").alias("times"))
    j = _whole(docs.where("doc_id is not null"), F.col("doc_id")).join(n, F.expr("rid = keep_id"))
    again = j.where("times > 1").groupBy("keep_id").agg(F.min("row").alias("row"))
    return j.where("times = 1").select("row.*").union(again.select("row.*")).union(docs.where("doc_id is null").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages: those go in which 13 or more words in a row are the benchmark's, and those of whose words
    one in twenty or more is (items of fewer words). Each row is judged by itself, whatever its doc_id.
    """
    found = decontaminate.with_verdict(decontaminate.contamination(docs.withColumn("doc_id", _row_hash(docs)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 13))
    passage = F.exists("hit_spans", lambda s: s["end_word"] - s["start_word"] >= 13)
    clean = found.where(~F.col("contaminated") & ~passage).select(F.col("doc_id").alias("clean_id")).distinct()
    return _whole(docs, _row_hash(docs)).join(clean, F.expr("rid = clean_id"), "left_semi").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it: sources in order weigh 5, 2, 1, repeating, and share 150 % of all words.

    Rows with a null doc_id are told apart by a hash of the whole row.
    """
    rid = F.coalesce(F.col("doc_id").cast("long"), _row_hash(docs))
    mixed = budget_mix.mix(docs.withColumn("doc_id", rid)).where("times > 0").select(F.col("doc_id").alias("mix_id"), "times")
    per = mixed.groupBy("mix_id").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    j = _whole(docs, rid).join(per, F.expr("rid = mix_id"))
    once = j.where("rows = 1").select("row", "times")
    again = j.where("rows > 1").groupBy("mix_id", "times").agg(F.min("row").alias("row")).select("row", "times")
    return once.union(again).select("row", F.explode(F.expr("sequence(1L, times)")).alias("nth")).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, in 40 shards of near equal bytes."""
    return kd_shards.shard(docs, 40)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
