"""Vector search: brute-force inner product in Arrow blocks with per-task top-k, quantizers, similar rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Query vectors and the rows nearest to them are held by every task; more than this many bytes or rows are searched in turns.
QUERY_BYTES, HELD = 64 << 20, 1 << 18
#: Scores that a task holds at a time.
TILE = 1 << 19


def unit(v: Column) -> Column:
    """The vector at length 1 in double precision; a zero vector stays zero.

    The length is a field of a one-element array's struct, so that it is computed once a vector and not once a component.
    """
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    both = F.array(F.struct(d.alias("d"), norm.alias("n")))
    return F.get(F.transform(both, lambda s: F.when(s["n"] > 0, F.transform(s["d"], lambda x: x / s["n"])).otherwise(s["d"])), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error where it has not dim components."""
    return F.when(F.assert_true(F.size(v) == dim, F.lit(f"vectors must have {dim} components")).isNull(), v)


def _best(q: np.ndarray, order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k first of their query by order (ascending), ties by id."""
    at = np.lexsort((ids, order, q))
    q = q[at]
    nth = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return at[nth < k]


def _scan(queries: DataFrame, rows: DataFrame, keep: int, digits: int, skip_self: bool, by_bits: bool) -> DataFrame:
    """(query_id, id, bits, score) of the keep rows nearest to each query in each task, by sign bits or by score.

    Queries are broadcast, at most QUERY_BYTES of them at a time and so many that their rows are HELD; a task scores tiles of TILE
    numbers and holds keep rows a query.
    """
    q = queries.select(F.col("query_id").cast("long"), F.col("v").cast("array<double>")).where("v is not null").toArrow()
    qid = np.array(q.column(0), np.int64)
    schema = "query_id long, id long, bits int, score double"
    spark = rows.sparkSession
    if not len(qid):
        return spark.createDataFrame([], schema)
    qv = _unit(np.array(q.column(1).to_pylist(), np.float64))
    step = max(1, min(QUERY_BYTES // (8 * qv.shape[1]), HELD // keep))

    def part(lo: int) -> DataFrame:
        shared = spark.sparkContext.broadcast((qid[lo : lo + step], qv[lo : lo + step]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vs = shared.value
            codes = _codes(vs)
            held = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.float64)]

            def best(found: list[list[np.ndarray]]) -> list[np.ndarray]:
                both = [np.concatenate(c) for c in zip(*found, strict=True)]
                kept = _best(both[0], both[2].astype(np.float64) if by_bits else -both[3], both[1], keep)
                return [c[kept] for c in both]

            for b in batches:
                if not b.num_rows:
                    continue
                rid = np.array(b.column(0), np.int64)
                x = _unit(np.array(b.column(1).flatten(), np.float64).reshape(len(rid), -1))
                own, found, n = _codes(x), [held], 0
                tile = max(1, TILE // len(rid))
                for at in range(0, len(ids), tile):
                    s = np.round(vs[at : at + tile] @ x.T, digits) + 0.0
                    bits = _apart(codes[at : at + tile], own) if by_bits else np.zeros(s.shape, np.int32)
                    order = bits.astype(np.float64) if by_bits else -s
                    if skip_self:
                        order[ids[at : at + tile, None] == rid[None]] = np.inf
                    near = np.isfinite(order)
                    if len(rid) > keep:
                        near &= order <= np.partition(order, keep - 1, axis=1)[:, keep - 1 : keep]
                    i, j = np.nonzero(near)
                    found.append([i + at, rid[j], bits[i, j], s[i, j]])
                    n += len(i)
                    if n > HELD:  # rows of equal bits or scores come beyond keep
                        found, n = [best(found)], 0
                held = best(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2].astype(np.int32)), pa.array(held[3])], names=["query_id", "id", "bits", "score"])

        return rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).where("v is not null").mapInArrow(run, schema)

    found = part(0)
    for lo in range(step, len(qid), step):
        found = found.union(part(lo))
    return found


def top_k(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, v) the k rows (id, v) with the largest inner product of unit vectors.

    Scores are rounded first and ties go to the smaller id, so every engine agrees. Queries are the small side; each task keeps
    its own best k per query, so what is shuffled is k rows per query and task. skip_self drops a row whose id is the query's.
    Null vectors are left out; repeated ids are rows of their own.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = _scan(queries, rows, k, digits, skip_self, by_bits=False).drop("bits")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def int8_ranges(rows: DataFrame) -> DataFrame:
    """(pos, lo, hi): each dimension's range, which trains the 8-bit quantizer.

    A task takes the minima and maxima of its vectors whole, so what is shuffled is two numbers a dimension and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for b in batches:
            if b.num_rows:
                x = _unit(np.array(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1))
                lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo), dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["pos", "lo", "hi"])

    own = rows.select(F.col("v").cast("array<double>")).where("v is not null").mapInArrow(run, "pos int, lo double, hi double")
    return own.groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def int8_codes(v: Column, lo: Column, hi: Column) -> Column:
    """Codes of 0 to 255, linear in each dimension's range."""
    return F.transform(F.arrays_zip(v.alias("x"), lo.alias("l"), hi.alias("h")), lambda t: F.when(t["h"] > t["l"], F.round((t["x"] - t["l"]) / (t["h"] - t["l"]) * 255)).otherwise(0).cast("int"))


def int8_decode(codes: Column, lo: Column, hi: Column) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), lo.alias("l"), hi.alias("h")), lambda t: t["l"] + t["c"] / 255.0 * (t["h"] - t["l"]))


def sign_bits(v: Column) -> Column:
    """The signs of a vector's components as longs of 64: bit i of word j is set where component 64 j + i is positive."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda n: F.aggregate(F.transform(F.slice(v, n * 64 + 1, F.lit(64)), bit), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / 64).cast("int")), word)


def hamming(a: Column, b: Column) -> Column:
    """In how many bits two vectors' sign_bits() differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _codes(x: np.ndarray) -> np.ndarray:
    bits = np.packbits(x > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def binary_nearest(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, skip_self: bool = False) -> DataFrame:
    """(query_id, id, bits, score, place): the k rows nearest by sign bits, ties by the smaller id, and their unit inner product."""
    w = W.partitionBy("query_id").orderBy("bits", "id")
    return _scan(queries, rows, k, digits, skip_self, by_bits=True).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def binary_top_k(queries: DataFrame, rows: DataFrame, k: int, factor: int = 20, digits: int = 6, skip_self: bool = False) -> DataFrame:
    """(query_id, id, bits, score, rank): the factor * k rows (id, v) nearest by sign bits to each query (query_id, v), rescored.

    The survivors are ranked by the inner product of unit vectors, and the best k stay. Scores are rounded first; ties in bits and
    in score go to the smaller id. Any number of components; null vectors are left out.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    near = binary_nearest(queries, rows, factor * k, digits, skip_self).drop("place")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bag_of_words(text: Column, vocabulary: list[str]) -> Column:
    """Counts of the vocabulary's words in a text, at length 1: a deterministic embedder for tests."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return unit(F.array(*[F.size(F.filter(words, lambda x, w=w: x == w)).cast("double") for w in vocabulary]))


def quantizer_drift(rows: DataFrame, sample: int = 100, k: int = 50, seed: int = 42, least: int = 10) -> DataFrame:
    """n, top1, topk: the mean best and mean k best scores of sampled rows (id, v) searched for among all rows once those have
    gone through the 8-bit quantizer. A sample by seeded hash; fewer than least rows give nulls."""
    r = int8_ranges(rows).orderBy("pos").toArrow()  # two numbers a dimension
    lo, hi = (np.array(r.column(i), np.float64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.where(hi > lo, hi - lo, 1)
        for b in batches:
            if b.num_rows:
                x = _unit(np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
                back = lo + np.round((x - lo) / span * 255) / 255 * (hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(back.reshape(-1)), back.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "v"])

    have = rows.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    back = have.mapInArrow(run, "id long, v array<double>")
    chosen = back.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select(F.col("id").alias("query_id"), "v")  # the sample is the feature
    found = top_k(chosen, back, k)
    per = found.groupBy("query_id").agg(F.max("score").alias("best"), F.avg("score").alias("mean"))
    few = F.count("*") < least
    return per.agg(F.count("*").alias("n"), F.when(few, None).otherwise(F.round(F.avg("best"), 6)).alias("top1"), F.when(few, None).otherwise(F.round(F.avg("mean"), 6)).alias("topk"))


def searchable(rows: DataFrame, sample: int = 20) -> str | None:
    """What a first search of a new index finds wrong with its vectors (id, v), or None: a vector must find itself with a score
    above 0, and scores must not all be equal where vectors differ."""
    asked = rows.where("v is not null").orderBy("id").limit(sample).select(F.col("id").alias("query_id"), "v")
    got = top_k(asked, rows, 5).agg(F.count("*").alias("n"), F.min(F.when(F.col("rank") == 1, F.col("score"))).alias("least"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.countDistinct("id").alias("ids")).first()
    if not got.n:
        return "no vectors"
    if got.least is None or got.least <= 0:
        return "a vector does not find itself"
    return "all scores are equal" if got.ids > 1 and got.lo == got.hi else None
