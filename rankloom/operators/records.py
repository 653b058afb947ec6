"""Change capture, integrity, statistics, graph scores, evaluation, evidence and reranking over tables of rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions import text as T


# ---- changes ----


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, hash): added, removed, modified or unchanged."""
    j = old.select("path", F.col("hash").alias("before")).join(new.select("path", F.col("hash").alias("after")), "path", "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified").otherwise("unchanged")
    return j.select("path", kind.alias("change"))


def to_reindex(ch: DataFrame) -> DataFrame:
    return ch.where("change in ('added', 'modified')").select("path")


def to_remove(ch: DataFrame) -> DataFrame:
    return ch.where("change in ('removed', 'modified')").select("path")


def apply_changes(chunks: DataFrame, ch: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of chunks (path, ...) whose file went or changed replaced by the fresh rows of the same columns."""
    return chunks.join(to_remove(ch), "path", "left_anti").unionByName(fresh)


def directory_hashes(files: DataFrame, depth: int) -> DataFrame:
    """(path, hash) of directories, bottom up: sha256 of the directory's own name and its children's sorted hashes.

    files: (path, hash). depth: parts of the longest path; the loop goes over levels, not rows.
    """
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    level = files.select("path", "hash", F.size(F.split("path", "/")).alias("level"))
    out = None
    for n in range(depth, 0, -1):
        here = level.where(F.col("level") == n) if out is None else level.where(F.col("level") == n).unionByName(dirs)  # noqa: F821
        name = F.element_at(F.split("parent", "/"), -1)
        dirs = here.select(parent.alias("parent"), "hash").groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("kids")).select(F.col("parent").alias("path"), F.sha2(F.concat(name, F.col("kids")), 256).alias("hash"), F.lit(n - 1).alias("level"))
        out = dirs if out is None else out.unionByName(dirs)
    return out.select("path", "hash")


def needs_refresh(age_minutes: Column, root_before: Column, root_now: Column, most: float = 5.0) -> Column:
    return age_minutes.isNull() | (age_minutes > most) | ~root_before.eqNullSafe(root_now)


def stale_ratio(total: Column, live: Column) -> Column:
    return F.greatest(total - live, F.lit(0)) / F.greatest(live, F.lit(1))


def change_patterns(ch: DataFrame) -> DataFrame:
    """(by, key, change, n): changes by extension and by directory."""
    ext = F.coalesce(F.nullif(F.regexp_extract("path", r"(\.[^./]+)$", 1), F.lit("")), F.lit("none"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    rows = ch.where("change <> 'unchanged'").select("change", F.explode(F.array(F.struct(F.lit("extension").alias("by"), ext.alias("key")), F.struct(F.lit("directory").alias("by"), folder.alias("key")))).alias("k"))
    return rows.groupBy("k.by", "k.key", "change").agg(F.count("*").alias("n"))


# ---- integrity and statistics ----


def orphans(rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return rows.join(valid.select(key).distinct(), key, "left_anti")


def folder_counts(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The n folders with most chunks, every ancestor counted (chunks: path)."""
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return chunks.select(F.explode(parts).alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(n)


def diagnostics(files: DataFrame) -> DataFrame:
    """attempted, with_chunks, zero, extracted, zero_rate of files (n_chunks)."""
    return files.agg(F.count("*").alias("attempted"), F.count_if(F.col("n_chunks") > 0).alias("with_chunks"), F.count_if(F.col("n_chunks") == 0).alias("zero"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("extracted"), F.round(F.count_if(F.col("n_chunks") == 0) / F.greatest(F.count("*"), F.lit(1)), 6).alias("zero_rate"))


def retained(rows: DataFrame, keys: list[str], newest: Column, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(newest))).where(F.col("_n") <= n).drop("_n")


def cache_misses(texts: DataFrame, cache: DataFrame, provider: str, model: str, mode: str) -> DataFrame:
    """Distinct (key, text) that the cache (key, provider, model, mode) has not: what is to be embedded."""
    keyed = texts.select(F.sha2("text", 256).alias("key"), "text")
    have = cache.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("mode") == mode)).select("key")
    return keyed.join(have, "key", "left_anti").dropDuplicates(["key"])


# ---- graph ----


def graph_scores(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, rounds: int = 5, damping: float = 0.85, most_nodes: int = 2000) -> DataFrame:
    """(path, score) by personalised PageRank on the one-hop neighbourhood of seed files.

    seeds (path, sim), nodes (id, path), edges (source, target, type); nodes are found as located() does. Edges count in both directions; an edge between two seeds
    is found from either end and so counts twice. Above most_nodes nodes only seeds stay. A node's seed mass is its file's
    similarity (0 at least) over the file's nodes, normalised; each round r = damping * walk + (1 - damping) * seed, mass at
    nodes without edges lost. A path's score is its nodes' mean, the largest scaled to 1. Fewer than two located paths: no rows.
    """
    at = located(seeds, nodes)
    size = at.groupBy("path").agg(F.count("*").alias("k"))
    mass = at.join(size, "path").select("id", "path", (F.greatest("sim", F.lit(0.0)) / F.col("k")).alias("m"))
    total = mass.agg(F.sum("m").alias("all"), F.countDistinct("path").alias("paths")).first()
    empty = seeds.sparkSession.createDataFrame([], "path string, score double")
    if (total.paths or 0) < 2 or not total.all:
        return empty
    e = edges.where(F.col("type").isin(types)) if types else edges
    ids = mass.select("id")
    out = e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "target")
    into = e.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    near = out.unionAll(into)
    if near.select("source").union(near.select("target")).distinct().count() > most_nodes:
        near = near.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    both = near.select(F.col("source").alias("u"), F.col("target").alias("v")).unionAll(near.select(F.col("target").alias("u"), F.col("source").alias("v"))).groupBy("u", "v").agg(F.count("*").alias("w"))
    deg = both.groupBy("u").agg(F.sum("w").alias("d"))
    step = both.join(deg, "u").select("u", "v", (F.col("w") / F.col("d")).alias("p"))
    seed = mass.select("id", (F.col("m") / total.all).alias("s"))
    r = seed.select("id", F.col("s").alias("r"))
    for _ in range(rounds):
        walk = r.join(step, r.id == step.u).groupBy(F.col("v").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("walk"))
        r = walk.join(seed, "id", "full").select("id", (damping * F.coalesce("walk", F.lit(0.0)) + (1 - damping) * F.coalesce("s", F.lit(0.0))).alias("r"))
    per = mass.select("id", "path").join(r, "id").groupBy("path").agg(F.avg("r").alias("x"))
    top = per.agg(F.max("x").alias("top"))
    return per.crossJoin(F.broadcast(top)).select("path", F.when(F.col("top") > 0, F.col("x") / F.col("top")).otherwise(0.0).alias("score"))


def located(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, sim, id): graph nodes (id, path) of candidate paths (path, sim): those of an equal path, or of a longer one that ends
    in it after a slash. An equality join on every such end of a node's path; characters of the path stand for themselves."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    own = nodes.select("id", F.explode(F.array_distinct(ends)).alias("path"))
    return paths.select("path", "sim").join(own, "path").select("path", "sim", "id").distinct()


def blend_scores(candidates: DataFrame, ppr: DataFrame, alpha: float) -> DataFrame:
    """Scores of candidates (path, score) times 1 + alpha times the path's graph score; alpha 0 changes nothing."""
    if alpha == 0:
        return candidates
    p = ppr.select("path", F.col("score").alias("ppr"))
    return candidates.join(p, "path", "left").withColumn("score", F.col("score") * (1 + alpha * F.coalesce("ppr", F.lit(0.0)))).drop("ppr")


# ---- evaluation ----

#: Differences that one array holds in a bootstrap.
MOST_DELTAS = 100_000


def reciprocal_rank(expected: Column, ranked: Column) -> Column:
    at = F.array_min(F.filter(F.transform(F.array_distinct(expected), lambda e: F.array_position(ranked, e)), lambda p: p > 0))
    return F.coalesce(1.0 / at, F.lit(0.0))


def hit_at(expected: Column, ranked: Column, k: int) -> Column:
    return F.arrays_overlap(expected, F.slice(ranked, 1, k)).cast("double")


def recall_at(expected: Column, ranked: Column, k: int) -> Column:
    gold = F.array_distinct(expected)
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, F.slice(ranked, 1, k))) / F.size(gold)).otherwise(0.0)


def summary(rows: DataFrame) -> DataFrame:
    """n, mrr, hr1, recall10 of rows (expected, ranked); zeros without rows."""
    e, r = F.col("expected"), F.col("ranked")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), mean(reciprocal_rank(e, r)).alias("mrr"), mean(hit_at(e, r, 1)).alias("hr1"), mean(recall_at(e, r, 10)).alias("recall10"))


def gold_rank(rows: DataFrame) -> DataFrame:
    """rows (query_id, expected, ranked) with gold_rank: the first place of ranked that is an expected path or ends in one (null:
    none)."""
    hits = F.filter(F.transform("ranked", lambda p, i: F.when(T.gold_match(p, F.col("expected")), i + 1)), lambda x: x.isNotNull())
    return rows.withColumn("gold_rank", F.array_min(hits))


def multi_turn(turns: DataFrame) -> DataFrame:
    """(id, anchor_shift, by_3, by_5, first_turn) of turns (id, anchor_shift, turn from 1, gold_rank): gold within 5 places in turns
    1 to 3, within 10 in turns 1 to 5, and the first turn with gold within 10."""
    within = lambda t, r: F.coalesce(F.bool_or((F.col("turn") <= t) & (F.col("gold_rank") <= r)), F.lit(False))
    return turns.groupBy("id", "anchor_shift").agg(within(3, 5).alias("by_3"), within(5, 10).alias("by_5"), F.min(F.when(F.col("gold_rank") <= 10, F.col("turn"))).alias("first_turn"))


def turn_hits(turns: DataFrame) -> DataFrame:
    """(turn, anchor_shift, n, hr_1, hr_5, hr_10) of turns (turn, anchor_shift, gold_rank)."""
    share = lambda k: F.round(F.avg(F.coalesce(F.col("gold_rank") <= k, F.lit(False)).cast("double")), 6)
    return turns.groupBy("turn", "anchor_shift").agg(F.count("*").alias("n"), *[share(k).alias(f"hr_{k}") for k in (1, 5, 10)])


def turn_summary(bundles: DataFrame) -> DataFrame:
    """(n, recall5_by_3, recall10_by_5, median_first_turn) of multi_turn() rows; the median is the upper one of those that have one."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    g = bundles.agg(F.count("*").alias("n"), mean("by_3").alias("recall5_by_3"), mean("by_5").alias("recall10_by_5"))
    m = upper_median(bundles.withColumn("_", F.lit(0)), ["_"], "first_turn", "median_first_turn").select("median_first_turn")
    return g.join(F.broadcast(m), F.lit(True), "left")  # one row each


def paired(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(query, before, after, delta) of queries (query, value) that both have; of a query's several rows the last by n counts."""
    last = lambda df: df.groupBy("query").agg(F.max_by("value", "n").alias("value"))
    j = last(baseline).withColumnRenamed("value", "before").join(last(treatment).withColumnRenamed("value", "after"), "query")
    return j.withColumn("delta", F.col("after") - F.col("before"))


def unpaired(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """(query, only_in): queries that one side alone has."""
    j = baseline.select("query").distinct().withColumn("a", F.lit(1)).join(treatment.select("query").distinct().withColumn("b", F.lit(1)), "query", "full")
    return j.where("a is null or b is null").select("query", F.when(F.col("a").isNull(), "treatment").otherwise("baseline").alias("only_in"))


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str = "p50") -> DataFrame:
    """The value at n div 2 of each group's sorted values (from 0); nulls left out.

    Equal values are counted first and then ranked by running sums of their counts, so no group is gathered into an array.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = W.partitionBy(*keys)
    upto = F.sum("_n").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(by))
    at = F.floor(F.col("_all") / 2)
    return ranked.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)).select(*keys, F.col(value).alias(name))


def bootstrap(deltas: DataFrame, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """n, mean, low, high of paired differences (delta); draws by hash, so that every run agrees. More than MOST_DELTAS fail."""
    if deltas.limit(MOST_DELTAS + 1).count() > MOST_DELTAS:
        raise ValueError(f"a bootstrap takes at most {MOST_DELTAS} differences")
    d = deltas.agg(F.array_sort(F.collect_list("delta")).alias("ds"))  # checked above
    spark = deltas.sparkSession
    draws = spark.range(resamples).crossJoin(F.broadcast(d))  # one row: the differences of a gold set
    n = F.size("ds")
    pick = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(F.col("ds"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.greatest(n, F.lit(1)).cast("long")).cast("int")))
    means = draws.select("ds", (F.aggregate(pick, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1))).alias("m"))
    low = int((1 - level) / 2 * resamples)
    high = min(int((1 + level) / 2 * resamples), resamples - 1)
    got = means.agg(F.first("ds").alias("ds"), F.array_sort(F.collect_list("m")).alias("ms"))
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("ds"), F.lit(1))
    return got.select(F.size("ds").alias("n"), mean.alias("mean"), F.coalesce(F.get("ms", F.lit(low)), F.lit(0.0)).alias("low"), F.coalesce(F.get("ms", F.lit(high)), F.lit(0.0)).alias("high"))


def floor_failures(summaries: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(arm, metric, value, floor) where an arm's metric (arm, metric, value) is missing or below its floor."""
    f = summaries.sparkSession.createDataFrame(list(floors.items()), "metric string, floor double")
    need = summaries.select("arm").distinct().crossJoin(F.broadcast(f))  # a handful of metrics
    return need.join(summaries, ["arm", "metric"], "left").where("value is null or value < floor")


def drift(current: DataFrame, baseline: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(project, status): new, missing, drift (a change strictly above threshold) or ok, of (project, score)."""
    j = current.select("project", F.col("score").alias("now")).join(baseline.select("project", F.col("score").alias("was")), "project", "full")
    return j.select("project", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.abs(F.col("now") - F.col("was")) > threshold, "drift").otherwise("ok").alias("status"))


# ---- evidence ----


_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def source_lines(chunks: DataFrame) -> DataFrame:
    """(path, line_no, line) of chunks (path, start_line, end_line, text) that are not blank; a chunk with more lines than its
    range, or without a path or range, gives none.

    A chunk is split once: whether its lines fit its range is told by counting line ends, before the split.
    """
    fits = (F.coalesce("path", F.lit("")) != "") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    n = F.regexp_count("text", F.lit(_LINE_ENDS)) + F.when(F.col("text").rlike(f"(?:{_LINE_ENDS})\\z"), 0).otherwise(1)
    rows = chunks.where(fits).where(n <= F.col("end_line") - F.col("start_line") + 1)
    lines = rows.select("path", "start_line", F.posexplode(F.split("text", _LINE_ENDS, -1)).alias("i", "line"))
    return lines.where(F.col("line").rlike(r"[^\s]")).select("path", (F.col("start_line") + F.col("i")).alias("line_no"), "line")


def chunk_metadata(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results (id, ...) with their chunks' path, lines and text; ids that no chunk has give no rows."""
    return results.join(chunks.select("id", "path", "start_line", "end_line", "text"), "id")


def evidence(lines: DataFrame, repository: str, revision: str, generation: str) -> DataFrame:
    """lines (path, line_no, line) with an id that depends on where and what they are, and a clipped snippet."""
    const = lambda x: F.lit(json.dumps(x, ensure_ascii=False))
    path = F.when(F.col("path").rlike(r'[\x00-\x1F"\\]'), T.json_text(F.col("path"))).otherwise(F.concat(F.lit('"'), "path", F.lit('"')))  # most need no escape
    eid = T.stable_id("ev", end_line=F.col("line_no").cast("string"), index_generation=const(generation), path=path, repository_id=const(repository), source_revision=const(revision), start_line=F.col("line_no").cast("string"), text_sha256=F.concat(F.lit('"'), F.sha2("line", 256), F.lit('"')))
    return lines.select("path", "line_no", eid.alias("evidence_id"), T.clip(F.trim("line"), 200).alias("snippet"))


# ---- reranking ----

RERANKERS: dict[str, Callable] = {}
T_REPLIES = "query_id long, ids array<string>"
#: Path prefixes with a setting of their own; more are no table of settings.
MOST_PREFIXES = 10_000


def reranker(name: str) -> Callable:
    """Registers rerank(results, k, **options) -> results; unknown names fall back to off."""

    def add(f: Callable) -> Callable:
        RERANKERS[name] = f
        return f

    return add


def rerank(name: str, results: DataFrame, k: int, **options) -> DataFrame:
    return RERANKERS.get(name, rerank_off)(results, k, **options)


@reranker("off")
def rerank_off(results: DataFrame, k: int, **_) -> DataFrame:
    """The best k of each query by score, ties by id; results: (query_id, id, score)."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("reason", F.lit("off"))


@reranker("pointwise")
def rerank_pointwise(results: DataFrame, k: int, judge: Column | None = None, pool: int = 15, confident: float | None = None, **_) -> DataFrame:
    """Judge scores of 0 to 10 (null: failed) for the best pool rows; the rest keep their places behind them.

    The order stays as it was, with the reason, for queries with at most k candidates, a best score of confident or more, over
    30 % failed scores, or no score of 6 or more.
    """
    q = W.partitionBy("query_id")
    r = results.withColumn("before", F.row_number().over(q.orderBy(F.desc("score"), "id")))
    r = r.withColumn("in_pool", F.col("before") <= pool).withColumn("judged", F.when(F.col("in_pool"), judge if judge is not None else F.lit(None).cast("double")))
    r = r.withColumn("n", F.count("*").over(q)).withColumn("top", F.max("score").over(q)).withColumn("failed", F.sum((F.col("in_pool") & F.col("judged").isNull()).cast("int")).over(q)).withColumn("pooled", F.sum(F.col("in_pool").cast("int")).over(q)).withColumn("best", F.max("judged").over(q))
    reason = F.when(F.col("n") <= k, "few_candidates").when(F.lit(confident is not None) & (F.col("top") >= (confident or 0.0)), "confident").when(F.col("failed") > 0.3 * F.col("pooled"), "failures").when(F.coalesce("best", F.lit(0.0)) < 6, "no_relevant").otherwise("applied")
    r = r.withColumn("reason", reason)
    order = q.orderBy(F.when(F.col("reason") != "applied", F.col("before")), F.when(F.col("in_pool"), 0).otherwise(1), F.col("judged").isNull(), F.desc("judged"), "before")
    return r.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*results.columns, "rank", "reason")


@reranker("listwise")
def rerank_listwise(results: DataFrame, k: int, replies: DataFrame | None = None, pool: int = 15, **_) -> DataFrame:
    """replies (query_id, ids, error): a model's order of the pool, error optional; anything but an exact permutation keeps the
    order. reason: applied, or few_candidates (no more than one), no_reply, the reply's error, duplicate_ids, unknown_ids or
    missing_ids. Of several replies to a query the smallest array counts.
    """
    q = W.partitionBy("query_id")
    r = results.withColumn("before", F.row_number().over(q.orderBy(F.desc("score"), "id")))
    if replies is None:
        replies = results.sparkSession.createDataFrame([], T_REPLIES)
    has = "error" in replies.columns
    said = replies.groupBy("query_id").agg(F.min(F.struct(F.col("ids").cast("array<string>").alias("ids"), (F.col("error") if has else F.lit(None)).cast("string").alias("error"))).alias("said"))
    own = r.where(F.col("before") <= pool).groupBy("query_id").agg(F.collect_list(F.col("id").cast("string")).alias("own"))  # pool ids
    ids = F.col("said.ids")
    bad = F.when(F.size("own") <= 1, "few_candidates").when(F.col("said").isNull(), "no_reply").when(F.col("said.error").isNotNull(), F.col("said.error")).when(ids.isNull(), "no_reply")
    bad = bad.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_ids").when(F.size(F.array_except(ids, F.col("own"))) > 0, "unknown_ids").when(F.size(F.array_except(F.col("own"), ids)) > 0, "missing_ids").otherwise("applied")
    judged = own.join(said, "query_id", "left").select("query_id", bad.alias("reason"), ids.alias("ids"))
    j = r.join(judged, "query_id", "left").withColumn("place", F.when((F.col("reason") == "applied") & (F.col("before") <= pool), F.array_position("ids", F.col("id").cast("string"))))
    order = q.orderBy(F.coalesce("place", F.col("before").cast("long")), "before")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*results.columns, "rank", "reason")


@reranker("cross_encoder")
def rerank_cross_encoder(results: DataFrame, k: int, model: Column | None = None, **_) -> DataFrame:
    """Scores replaced by a model's over all candidates."""
    r = results.withColumn("score", model if model is not None else F.col("score"))
    return rerank_off(r, k).withColumn("reason", F.lit("cross_encoder"))


# What went wrong with a judge's call, and the public reasons.
RATE_LIMIT, TIMEOUT, TOO_MANY = "rate_limit", "timeout", "too_many_failures"


def failure_reason(failures: DataFrame) -> DataFrame:
    """(query_id, reason) of failed calls (query_id, error): rate_limit where it is the most frequent or one short of it, else
    timeout likewise, else too_many_failures."""
    per = failures.groupBy("query_id", "error").agg(F.count("*").alias("n"))
    n = lambda e: F.coalesce(F.sum(F.when(F.col("error") == e, F.col("n"))), F.lit(0))
    g = per.groupBy("query_id").agg(F.max("n").alias("most"), n(RATE_LIMIT).alias("limited"), n(TIMEOUT).alias("late"))
    near = lambda c: (F.col(c) > 0) & (F.col(c) >= F.col("most") - 1)
    return g.select("query_id", F.when(near("limited"), RATE_LIMIT).when(near("late"), TIMEOUT).otherwise(TOO_MANY).alias("reason"))


def prompt_clauses(results: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query_id, id, clauses): texts of the clauses (prefix, clause) whose prefix a candidate's path starts with, by prefix."""
    if clauses.limit(MOST_PREFIXES + 1).count() > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    j = results.select("query_id", "id", "path").join(F.broadcast(clauses), F.col("path").startswith(F.col("prefix")))  # checked above
    return j.groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "clause"))), lambda x: x["clause"]).alias("clauses"))  # a table of settings


def threshold_by_prefix(results: DataFrame, overrides: DataFrame, default: float) -> DataFrame:
    """Per query the largest threshold of the prefixes (prefix, threshold) that its candidates' paths start with, else default."""
    if overrides.limit(MOST_PREFIXES + 1).count() > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    j = results.join(F.broadcast(overrides), F.col("path").startswith(F.col("prefix")), "left")  # checked above
    return j.groupBy("query_id").agg(F.coalesce(F.max("threshold"), F.lit(default)).alias("threshold"))
