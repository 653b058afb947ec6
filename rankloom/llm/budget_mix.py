"""Mixing sources to target weights: exact token-length counts, bounded-knapsack fitting of each source's budget, seeded choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, staged

#: The knapsack settles at most this many words of a source's budget; what is above is taken in proportion first.
DP_WORDS = 1 << 15
#: Sources are metadata: their names and sizes are gathered, and more than this many raise an error.
MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], total: float, epochs: float) -> list[float]:
    """Shares of total by weight; a share stops at epochs times its size and the excess is reshared, until none is above."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= epochs * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = float(epochs * sizes[i])
        left -= sum(epochs * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near below budget as can be (bounded-knapsack DP over bitsets)."""
    use = np.zeros(len(lengths), np.int64)
    items = [(i, int(n)) for i, n in enumerate(np.minimum(counts, budget // np.maximum(lengths, 1))) if 0 < lengths[i] <= budget and n > 0]
    mask, seen, reach = (1 << budget + 1) - 1, [], 1
    for i, n in items:  # powers of two make any count up to n
        part = 1
        while n > 0:
            k = min(part, n)
            seen.append((i, k, reach))
            reach |= reach << k * int(lengths[i]) & mask
            n, part = n - k, part * 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(seen):
        if not before >> at & 1:
            at -= k * int(lengths[i])
            use[i] += k
    return use


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a budget: in proportion down to DP_WORDS, the rest by knapsack()."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = min(budget, total)
    bulk = max(0, budget - DP_WORDS)
    done = wanted = 0
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] <= 0:
            continue
        wanted += int(lengths[i]) * int(counts[i]) * bulk // max(total, 1)
        n = min(int(counts[i]), max(0, wanted - done) // int(lengths[i]))
        take[i] = n
        done += n * int(lengths[i])
    rest = budget - done
    while rest > DP_WORDS:  # lengths above the window: the longest that still fit
        fits = np.flatnonzero((counts > take) & (lengths > 0) & (lengths <= rest))
        if not len(fits):
            break
        i = fits[np.argmax(lengths[fits])]
        n = min(int(counts[i] - take[i]), max(1, (rest - DP_WORDS) // int(lengths[i])))
        take[i] += n
        rest -= n * int(lengths[i])
    return take + knapsack(lengths, counts - take, min(rest, 2 * DP_WORDS))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) per row of docs (doc_id, text, source).

    size: words of the text (null: 0). Sources in order of code point, null last, weigh weights, repeating; together they are to
    give share times all words, each at most epochs times its own (fill_targets). A source takes every document as many whole
    times as its target allows, and once more those that fit() chooses by length; among documents of one length the smallest
    seeded hashes of doc_id come first (ties: doc_id), so reruns agree. Documents of size 0 are never taken. Repeated rows count
    as rows. Extra columns are ignored; empty input gives no rows.

    Ranks are taken within (source, length, one of 64 seeded slices) and shifted by counts of the slices before, so a source or
    length with a third of all rows is still dealt over many tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    seeded = F.xxhash64(F.lit(seed), "doc_id")
    rows = staged(rows.withColumn("h", seeded).withColumn("slice", F.pmod("h", F.lit(64))), "sizes")
    counts = staged(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "lengths")
    per = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [int(r.words or 0) for r in per]
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share * sum(sizes), epochs)
    plan = spark.createDataFrame([(r.source, s, t) for r, s, t in zip(per, sizes, targets, strict=True)], "source string, source_size long, target double")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        pdf["extra"] = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]))
        return pdf[["source", "size", "extra", "whole", "source_size", "target"]]

    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    chosen = lengths.join(F.broadcast(plan) if len(per) <= 10_000 else plan, lengths.source.eqNullSafe(plan.source)).select(lengths.source, "size", "n", "whole", "budget", "source_size", "target")
    chosen = chosen.groupBy("source").applyInPandas(choose, "source string, size long, extra long, whole long, source_size long, target double")
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("before", before).alias("c").join(chosen.alias("k"), F.expr("c.source <=> k.source and c.size = k.size")).select("c.source", "c.size", "c.slice", "before", "n", "extra", "whole", "source_size", "target")
    cut = staged(cut, "cuts")
    j = rows.alias("r").join(cut.alias("c"), F.expr("r.source <=> c.source and r.size = c.size and r.slice = c.slice"))
    rank = F.row_number().over(W.partitionBy("r.source", "r.size", "r.slice").orderBy("h", "doc_id"))
    j = j.select("doc_id", "r.source", "r.size", "source_size", "target", "whole", "extra", "before", "n", rank.alias("rank"))
    times = F.when(F.col("size") > 0, F.col("whole") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).otherwise(0).cast("long")
    return j.withColumn("times", times).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
