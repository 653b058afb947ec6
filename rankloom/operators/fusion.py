"""Rank fusion, dedupe, interleaving and localisation over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def rrf(arms: list[tuple[DataFrame, float]], k: int = 20) -> DataFrame:
    """(query_id, id, score, first_arm): each arm's rows (query_id, id, rank from 1) give weight / (k + rank); sums by id.

    A union and one aggregation, no join; first_arm is the first arm that has the row, which breaks ties as the arms are listed.
    """
    rows = None
    for i, (arm, weight) in enumerate(arms):
        one = arm.select("query_id", "id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"), F.lit(i).alias("arm"), F.col("rank").alias("arm_rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.min(F.struct("arm", "arm_rank")).alias("first_arm"))


def best_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in the given order."""
    return ranked(df, keys, *order, name="_nth").where("_nth = 1").drop("_nth")


def top(df: DataFrame, k: int, by: list[str], *order: Column | str) -> DataFrame:
    return ranked(df, by, *order).where(F.col("rank") <= k)


def resort_by_signals(arm: DataFrame, boost: Column) -> DataFrame:
    """An arm's ranks anew by abs(score) times boost, ties by id."""
    return ranked(arm.withColumn("_s", F.abs("score") * boost), ["query_id"], F.desc("_s"), "id").drop("_s")


def candidate_k(k: int, explicit: bool) -> int:
    return min(200, max(50, 4 * k if explicit else 50))


def interleave(results: DataFrame, top_k: int = 25, per_project: int = 3) -> DataFrame:
    """Rows (project, id, score) round robin: the best of each project in order of project, then the second, and so on."""
    if not 1 <= top_k <= 100 or not 1 <= per_project <= 20:
        raise ValueError("top_k must be 1 to 100 and per_project 1 to 20")
    own = ranked(results, ["project"], F.desc("score"), "id", name="project_rank").where(F.col("project_rank") <= per_project)
    first = own.orderBy("project_rank", "project").limit(top_k)
    return first.withColumn("global_rank", F.row_number().over(W.orderBy("project_rank", "project")))


def localize(results: DataFrame, k: int = 10, chunks: int = 3) -> DataFrame:
    """Files of ranked chunks (path, id, kind, score): 0.6 best + 0.3 log10(1 + chunks) + 0.1 min(1, kinds / 4); the best ids."""
    r = results.where(F.trim(F.coalesce("path", F.lit(""))) != "")
    g = r.groupBy("path").agg(F.max("score").alias("best"), F.count("*").alias("n_chunks"), F.countDistinct("kind").alias("n_kinds"))
    s = 0.6 * F.col("best") + 0.3 * F.log10(1 + F.col("n_chunks")) + 0.1 * F.least(F.lit(1.0), F.col("n_kinds") / 4)
    files = g.withColumn("score", F.round(s, 6)).orderBy(F.desc("score"), "path").limit(k)
    ids = top(r.join(F.broadcast(files.select("path")), "path", "left_semi"), chunks, ["path"], F.desc("score"), "id")  # k files
    best = ids.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("t")).select("path", F.expr("transform(t, x -> x.id)").alias("top_ids"))
    return files.join(best, "path")


def file_context(chunks: DataFrame, match: Column, limit: int = 20) -> DataFrame:
    """A file's chunks in order of start_line (null last), cut to limit, with total and truncated."""
    m = chunks.where(match)
    n = m.agg(F.count("*").alias("total"))
    kept = m.orderBy(F.asc_nulls_last("start_line"), "id").limit(limit)
    return kept.crossJoin(F.broadcast(n)).withColumn("truncated", F.col("total") > limit)  # one row


def agentic_blend(baseline: DataFrame, model: DataFrame, k: int = 20) -> DataFrame:
    """Baseline and model order, half each."""
    return rrf([(baseline.where("rank <= 10"), 0.5), (model, 0.5)], k)
