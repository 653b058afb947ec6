"""Sharding by a k-d tree: nodes split at distributed weighted quantiles along their widest metadata dimension until leaves
reach the target bytes. DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import drop_staged, staged

#: Bins of the histograms that find a quantile; each refinement divides the interval by so many.
BINS = 1024
REFINEMENTS = 3
#: Groups of at least this part of a shard's target may be moved between leaves in the end; there are at most shards * MOVABLE.
MOVABLE = 32
#: Shards are even once they differ by at most this part of the target.
EVEN = 0.002
DIMS = ("x0", "x1", "x2")


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _pick(values: list, index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index + 1)


def _dim(which: Column) -> Column:
    return F.when(which == 0, F.col("x0")).when(which == 1, F.col("x1")).otherwise(F.col("x2"))


def _tree(groups: DataFrame, quotas: list[float]) -> DataFrame:
    """groups with node: the leaf of the tree that each falls in."""
    nodes, at = [list(range(len(quotas)))], groups.withColumn("node", F.lit(0))
    while any(len(n) > 1 for n in nodes):
        box = {r.node: r for r in at.groupBy("node").agg(*[f(d).alias(f"{n}{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))], F.sum("w").alias("w")).collect()}
        dims, lo, hi, want = [], [], [], []
        for i, leaves in enumerate(nodes):
            b = box.get(i)
            span = [b[f"hi{d}"] - b[f"lo{d}"] for d in DIMS] if b else [0.0] * 3
            d = max(range(3), key=lambda k: span[k])
            dims.append(d)
            lo.append(float(b[f"lo{DIMS[d]}"]) if b else 0.0)
            hi.append(float(b[f"hi{DIMS[d]}"]) + 1e-9 if b else 1.0)
            left = sum(quotas[k] for k in leaves[: len(leaves) // 2])
            all_ = sum(quotas[k] for k in leaves)
            want.append((b.w if b else 0) * (left / all_ if all_ > 0 else 0.5))
        passed = [0.0] * len(nodes)
        for turn in range(REFINEMENTS):
            v = _dim(_pick(dims, F.col("node"), "int"))
            low, high = _pick(lo, F.col("node"), "double"), _pick(hi, F.col("node"), "double")
            part = at.withColumn("v", v).where((F.col("v") >= low) & (F.col("v") < high))
            bins = part.groupBy("node", F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("w").alias("w"))
            hist: dict[int, dict[int, int]] = {}
            for r in bins.collect():  # at most BINS rows for each node, and a level has at most as many nodes as shards
                hist.setdefault(r.node, {})[r.bin] = r.w
            for i in range(len(nodes)):
                have, got, width = passed[i], hist.get(i, {}), (hi[i] - lo[i]) / BINS
                for k in range(BINS):
                    if have + got.get(k, 0) >= want[i] or k == BINS - 1:
                        lo[i], hi[i], passed[i] = lo[i] + k * width, lo[i] + (k + 1) * width, have
                        break
                    have += got.get(k, 0)
                wl = got.get(k, 0)
                if wl and passed[i] + wl - want[i] < want[i] - passed[i]:
                    near = hi[i]
                else:
                    near = lo[i]
                if turn == REFINEMENTS - 1:
                    lo[i] = near
        split, nxt, kids = [len(n) > 1 for n in nodes], [], []
        for i, leaves in enumerate(nodes):
            half = len(leaves) // 2
            kids.append((len(nxt), len(nxt) + (1 if split[i] else 0)))
            nxt += [leaves[:half], leaves[half:]] if split[i] else [leaves]
        after = staged(at.withColumn("node", _step(F.col("node"), dims, lo, kids)), "level")
        if hasattr(at, "_staged_path"):
            drop_staged(at)
        nodes, at = nxt, after
    return at


def evened(load: list[float], items: list[tuple[int, float, int]], target: float) -> dict[int, int]:
    """Moves (item: shard) of items (item, weight, shard) that even out the shards' loads, heaviest first, as few as it takes.

    Each turn moves one item from the fullest shard that can give to the emptiest that can take, or swaps it with one there,
    whichever brings the two closest together; it ends when the shards are even or nothing helps.
    """
    load, at = list(load), {i: s for i, _, s in items}
    own: list[list[tuple[float, int]]] = [sorted((w, i) for i, w, s in items if s == k) for k in range(len(load))]
    for _ in range(20 * len(load) + len(items)):
        order, best = sorted(range(len(load)), key=lambda k: load[k]), None
        for hi, lo in ((hi, lo) for hi in reversed(order) for lo in order if load[hi] - load[lo] > EVEN * target):
            gap, swaps = load[hi] - load[lo], [(0.0, None), *own[lo]]
            for w, i in own[hi]:
                k = bisect_left(swaps, w - gap / 2, key=lambda x: x[0])
                for v, j in swaps[max(0, k - 1) : k + 1]:
                    left = abs(gap - 2 * (w - v))
                    if 0 < w - v < gap and (best is None or left - gap < best[0]):
                        best = (left - gap, hi, lo, (w, i), (v, j))
            if best:
                break
        if not best:
            break
        _, hi, lo, (w, i), (v, j) = best
        own[hi].remove((w, i))
        insort(own[lo], (w, i))
        at[i] = lo
        if j is not None:
            own[lo].remove((v, j))
            insort(own[hi], (v, j))
            at[j] = hi
        load[hi] -= w - v
        load[lo] += w - v
    return {i: at[i] for i, _, s in items if at[i] != s}


def _step(node: Column, dims: list[int], cut: list[float], kids: list[tuple[int, int]]) -> Column:
    right = _dim(_pick(dims, node, "int")) >= _pick(cut, node, "double")
    return F.when(right, _pick([k[1] for k in kids], node, "int")).otherwise(_pick([k[0] for k in kids], node, "int"))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of docs (doc_id, text, lang, source).

    Rows of equal text are a group and stay together. Metadata dimensions, each scaled to 0..1: source, lang (ranked by a hash;
    a group takes the smallest of its rows) and the logarithm of the group's bytes; a hash of the text breaks ties, so a source
    with a third of all rows splits as well. Groups larger than a whole shard get shards of their own, at most as many as there
    are shards; the tree places all others. Splits fall between groups, so leaves of large groups come out uneven: then groups of
    at least 1/32 of a shard, at most 32 for each shard, are moved or swapped between leaves until the shards are even.
    Slots count from 0 without gaps, in order of a slice of doc_id, doc_id, and size. Null text: 16 bytes, a group of its own;
    null metadata rank as a value. Repeated rows keep their multiplicity; extra columns are ignored; empty input gives no rows.
    """
    unit = lambda h: F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_bytes(F.col("text").cast("string")).alias("size"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("n"))).alias("g"), unit(F.xxhash64(F.lit(1), F.col("source").cast("string"))).alias("s"), unit(F.xxhash64(F.lit(2), F.col("lang").cast("string"))).alias("l"))
    rows = staged(rows, "rows")
    tie = unit(F.xxhash64(F.lit(3), "g"))
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.min("s").alias("s"), F.min("l").alias("l"))
    wide = F.log2(F.col("w").cast("double")) / 64
    groups = staged(groups.select("g", "w", (F.col("s") + tie * 1e-3).alias("x0"), (F.col("l") + tie * 1e-3).alias("x1"), (wide + tie * 1e-4).alias("x2")), "groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    target = total / shards
    large = groups.where(F.col("w") > target).orderBy(F.desc("w"), "g").select("g", "w").collect() if total else []
    load, place = [0.0] * shards, []
    for k, r in enumerate(large):  # fewer than shards, as their sum is at most shards * target
        load[k] = float(r.w)
        place.append((r.g, k))
    spread, left = [max(0.0, target - x) for x in load], total - sum(load)
    quotas = [x * left / (sum(spread) or 1) for x in spread]
    homes = _tree(groups.where(F.col("w") <= target), quotas).select("g", "w", F.col("node").cast("int").alias("shard"))
    homes = staged(homes, "leaves")
    for r in homes.groupBy("shard").agg(F.sum("w").alias("w")).collect():
        load[r.shard] += r.w
    moves = evened(load, [(r.g, float(r.w), r.shard) for r in homes.where(F.col("w") >= target / MOVABLE).orderBy("g").collect()], target) if total else {}
    homes = homes.select("g", "shard")
    if moves:
        to = docs.sparkSession.createDataFrame(list(moves.items()), "g long, to int")
        homes = homes.join(F.broadcast(to), "g", "left").select("g", F.coalesce("to", "shard").alias("shard"))  # at most shards * MOVABLE rows
    if place:
        homes = homes.union(docs.sparkSession.createDataFrame(place, "g long, shard int"))
    placed = staged(rows.select("doc_id", "size", "text_crc32", "g").join(homes, "g").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "slice"), "placed")
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = counts.select("shard", "slice", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32"))
    slots = placed.withColumn("rank", rank).join(F.broadcast(before), ["shard", "slice"])  # 64 rows for each shard at most
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
