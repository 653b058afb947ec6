"""What the training-data operators share: staged tables, connected components, bucket pairs and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A long list's members are dealt in blocks of about so many.
LIST_BLOCK = 512
#: Most bits of a bit set of shingles.
MOST_BITS = 1 << 18
#: Every character that separates words in these operators: space and ASCII 9 to 13.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, one of our own if the whole of Spark
    runs on this machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(spark, "_rankloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark._rankloom_dir = base
    return base.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/rankloom/{uuid.uuid4().hex}-{name}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


#: Bytes of an Arrow batch in staged writes: batches of pairs of long texts are several copies of this in an executor.
BATCH_BYTES = 8 << 20
#: Settings of staged writes. A step's shuffle files go when it is written, not when the driver next collects garbage; the text
#: form of plans, made anew after every stage of a query, is cut (the plans themselves are not).
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": True, "spark.sql.maxPlanStringLength": 1 << 13}


def staged(df: DataFrame, name: str, dense: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    dense: packed by zstd, for columns of texts or bit sets.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    writing = _WRITING | ({"spark.sql.parquet.compression.codec": "zstd"} if dense else {})
    before = {k: conf.get(k, None) for k in writing}
    for k, v in writing.items():
        conf.set(k, v)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    for df in frames:
        fs, p = _fs(df.sparkSession, df._staged_path)
        fs.delete(p, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, component): the smallest node that links reach, for each node of a link.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two grouped minima and two joins, and a
    group's members never meet in one row. Self links give a node its own component; null ends are ignored; no links, no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u is not null and v is not null")
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    first = e
    cur, before = e.where("u > v"), None
    held = None
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = j.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        nxt = staged(small, "star")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held is not None:
            drop_staged(held)
        cur = held = nxt
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out = staged(nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    drop_staged(first, held)
    return out


def grown(links: DataFrame, comp: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and their components with more (staged links) added; without more, as they were."""
    if not more.limit(1).count():
        return links, comp
    links = links.union(more)
    return links, components(links)


def posting_lists(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of lists that have two rows or more, with the list's length as n; written once."""
    return staged(postings.withColumn("n", F.count("*").over(W.partitionBy(*keys))).where("n > 1"), "postings")


def bits_of(h: np.ndarray) -> np.ndarray:
    """A set of hashes as a bit set of eight bits a hash or more, a power of two from 512 to MOST_BITS, as bytes.

    Each bit in which two sets of one length differ is a hash that one of them has alone, so the differing bits never exceed the
    difference of the sets. A longer bit set folded by OR is the shorter one of the same hashes.
    """
    n = min(MOST_BITS, max(512, 1 << int(8 * max(1, len(h)) - 1).bit_length()))
    out = np.zeros(n, np.uint8)
    out[(h & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def _folded(rows: list[bytes], size: int) -> np.ndarray:
    """Bit sets of a size in bytes or twice that as a matrix of longs of that size."""
    m = np.stack([np.frombuffer(r, np.uint64) for r in rows])
    return m if m.shape[1] * 8 == size else m[:, : size // 8] | m[:, size // 8 :]


def near_in_block(x: pd.DataFrame, y: pd.DataFrame, similarity: float, best: bool) -> list[tuple[int, int]]:
    """Pairs of x and y (node, component, size, bits) of unequal components that the bit sets allow to be so similar.

    best: only the nearest such y of each x.
    """
    out: list[tuple[int, int]] = []
    if not len(x) or not len(y):
        return out
    share = (1 - similarity) / (1 + similarity)
    long_x, long_y = x["bits"].str.len().to_numpy(), y["bits"].str.len().to_numpy()
    ny, cy, ky = y["node"].to_numpy(), y["component"].to_numpy(), y["size"].to_numpy()
    for size in np.unique(long_x):
        xs = np.flatnonzero(long_x == size)
        found: dict[int, tuple[float, int]] = {}
        for other in {int(size) // 2, int(size), 2 * int(size)}:
            ys, low = np.flatnonzero(long_y == other), min(int(size), other)
            if not len(ys):
                continue
            my, mx = _folded([y["bits"].iat[i] for i in ys], low), _folded([x["bits"].iat[i] for i in xs], low)
            for row, i in zip(mx, xs, strict=True):
                both = ky[ys] + int(x["size"].iat[i])
                apart = np.bitwise_count(my ^ row).sum(axis=1, dtype=np.int64) / np.maximum(1, both)
                ok = (apart <= share + 1e-9) & (cy[ys] != x["component"].iat[i])
                if not ok.any():
                    continue
                node = int(x["node"].iat[i])
                if best:
                    k = int(np.where(ok, apart, np.inf).argmin())
                    found[i] = min(found.get(i, (np.inf, 0)), (float(apart[k]), int(ny[ys[k]])))
                else:
                    out += [(node, int(z)) for z in ny[ys[ok]]]
        out += [(int(x["node"].iat[i]), z) for i, (_, z) in found.items()]
    return out


def near_in_lists(lists: DataFrame, bits: DataFrame, similarity: float, best: bool) -> DataFrame:
    """(a, b) of unequal components in long lists (slot, key, node, component) whose bit sets (node, size, bits) allow a link.

    The members of a list's largest component are linked already, so only the others are held against the whole list, in blocks
    that meet in one task each: only the pairs found become rows. A member meets its bit set once, before it is dealt to blocks.
    """

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(near_in_block(pdf[pdf["asks"]], pdf[~pdf["asks"]], similarity, best), columns=["a", "b"]).astype("int64")

    of = lists.groupBy("slot", "key", "component").agg(F.count("*").alias("n"))
    of = of.groupBy("slot", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).select("slot", "key", "n", F.col("top.component").alias("major"), (F.col("n") - F.col("top.n")).alias("rest"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / LIST_BLOCK)).cast("int")
    at = lambda c: F.pmod(F.xxhash64(F.lit(5), "node"), blocks(c)).cast("int")
    all_ = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    place = lambda asks, bx, by: F.struct(F.lit(asks).alias("asks"), bx.cast("int").alias("bx"), by.cast("int").alias("by"))
    asks = F.when(F.col("component") != F.col("major"), F.transform(all_("n"), lambda i: place(True, at("rest"), i))).otherwise(F.array())
    held = F.transform(all_("rest"), lambda i: place(False, i, at("n")))
    told = lists.select("slot", "key", "node", "component").join(of.where("rest > 0"), ["slot", "key"]).join(bits, "node")
    told = told.select("slot", "key", "node", "component", "size", "bits", F.explode(F.concat(asks, held)).alias("to"))
    found = told.select("slot", "key", "to.asks", "to.bx", "to.by", "node", "component", "size", "bits").groupBy("slot", "key", "bx", "by").applyInPandas(block, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_P = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time, so that temporary arrays stay small however long a text is.
BLOCK = 1 << 20


def _hash_block(b: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    keep = ~gaps[b]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(at)))
    inner = np.arange(len(at)) - np.repeat(starts, lens)
    val = (_LOWER[b[at]].astype(np.uint64) + np.uint64(1)) * _P[inner & 255]
    return mixed(np.add.reduceat(val, starts) + lens.astype(np.uint64))


def word_hashes(data: bytes, letters: bool = False) -> np.ndarray:
    """A 64-bit hash of each word (split at SPACE, A-Z lower-cased) of UTF-8 bytes, in order; numpy only, in bounded blocks.

    letters: words are runs of ASCII letters, digits and non-ASCII characters instead.
    """
    b, gaps = np.frombuffer(data, np.uint8), _NOT_LETTER if letters else _IS_SPACE
    if len(b) <= BLOCK:
        return _hash_block(b, gaps)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + BLOCK)
        while end < len(b) and not _IS_SPACE[b[end]]:
            gap = np.flatnonzero(_IS_SPACE[b[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(len(b), end + BLOCK)
        out.append(_hash_block(b[at:end], gaps))
        at = end
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; with fewer words none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : i + n]
    return mixed(h)
