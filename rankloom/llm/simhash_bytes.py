"""SimHash near-dedup by an inverted index over positional bytes with count filtering.

Two fingerprints of B bytes that differ in d bits agree in at least B - d positional bytes. Posting lists are keyed by groups of
positional bytes (single-byte lists would hold 1/256 of all rows each); the shared bytes of a pair are then tallied, pairs that
reach the minimum are kept, and the rest is verified by differing bits. The pipeline's stage, exact similarity of the texts'
shingle sets, does the same with longer fingerprints of the sets. There no choice of bytes is both selective and complete at 0.8,
so lists of minima over the sets come beside them for the pairs that the bytes leave out.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bits_of, components, drop_staged, grown, mixed, near_in_lists, posting_lists, staged

SEED = 42
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of so many words of the A-Z-lower-cased text, space-joined; a shorter text is one run."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    line, digest = b" ".join(w), xxhash.xxh64_digest
    ends = list(itertools.accumulate(map(len, w), lambda a, n: a + n + 1))
    hs = b"".join([digest(line[a:b], SEED) for a, b in zip([0, *[e + 1 for e in ends]], ends[words - 1 :])])
    return np.frombuffer(hs, ">u8").astype(np.uint64)


def fingerprint(h: np.ndarray, lanes: int = 1) -> list[int]:
    """64-bit lanes of majority bits, as signed longs: bit i is 1 if set in over half the hashes. No hashes: zero.

    The first lane counts the hashes themselves, later lanes mix them with a constant of their own.
    """
    out = []
    for lane in range(lanes):
        x = h if not lane else mixed(h + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1))
        v = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        if len(v) > 96:
            ones = np.concatenate([np.bincount(v[:, i], minlength=256) @ _BITS for i in range(8)])
        else:
            ones = np.unpackbits(v, axis=1, bitorder="little").sum(axis=0) if len(v) else np.zeros(64, int)
        out.append(int(np.packbits(ones * 2 > len(v), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp array<long>) of whole texts; null or empty text: all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words), lanes) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp array<long>")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255))


def _key(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions as one long (at most seven of them)."""
    out = F.lit(0).cast("long")
    for j, i in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(_byte(fp, i), 8 * j))
    return out


def _tally(a: Column, b: Column, lanes: int) -> Column:
    return sum((F.when(_byte(a, i) == _byte(b, i), 1).otherwise(0) for i in range(1, 8 * lanes)), F.when(_byte(a, 0) == _byte(b, 0), 1).otherwise(0))


def _differ(a: Column, b: Column, lanes: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, lanes)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _postings(classes: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), _key(F.col("fp"), s).alias("key")) for i, s in enumerate(subsets)])
    return posting_lists(classes.select("rep", "fp", "weight", F.explode(rows).alias("p")).select("rep", "fp", "weight", "p.slot", "p.key"), ["slot", "key"])


def guaranteed_subsets(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of the 8 byte positions of which one must agree whole if at most max_bits bits differ: pairs of max_bits + 2 blocks."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4: beyond it the lists' keys get too short")
    blocks = [tuple(int(x) for x in part) for part in np.array_split(np.arange(8), max_bits + 2)]
    return [a + b for a, b in itertools.combinations(blocks, 2)]


def close_links(classes: DataFrame, max_bits: int = 2, list_limit: int | None = None) -> DataFrame:
    """(a, b) of all classes (rep long, fp array<long> of one lane, weight) at most max_bits bits apart; complete.

    Lists longer than the number of ways to change max_bits bits outside their key are not paired: each member's changed
    fingerprints are looked up instead, which finds the same links in work that is linear in the list's length.
    """
    subsets = guaranteed_subsets(max_bits)
    flips = []
    for slot, s in enumerate(subsets):
        free = [8 * i + b for i in range(8) if i not in s for b in range(8)]
        masks = [sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in itertools.combinations(free, k)]
        flips += [(slot, m - (1 << 64) if m >> 63 else m) for m in masks]
    limit = list_limit or len(flips) // len(subsets)
    lists = _postings(classes, subsets)
    short = lists.where(F.col("n") <= limit)
    x, y = short.select("slot", "key", F.col("rep").alias("a"), F.col("fp").alias("fa")), short.select("slot", "key", F.col("rep").alias("b"), F.col("fp").alias("fb"))
    need = 8 - max_bits
    pairs = x.join(y, ["slot", "key"]).where("a < b").where(_tally(F.col("fa"), F.col("fb"), 1) >= need).where(_differ(F.col("fa"), F.col("fb"), 1) <= max_bits).select("a", "b")
    long_ = lists.where(F.col("n") > limit)
    if not long_.limit(1).count():
        return pairs.distinct()
    masks = F.broadcast(classes.sparkSession.createDataFrame(flips, "slot int, mask long"))  # a fixed table: its size depends on max_bits alone
    looked = long_.join(masks, "slot").select(F.col("rep").alias("a"), F.col("fp")[0].bitwiseXOR(F.col("mask")).alias("f"))
    found = looked.join(classes.select(F.col("rep").alias("b"), F.col("fp")[0].alias("f")), "f")
    return pairs.union(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def classes_of(fps: DataFrame) -> DataFrame:
    """Equal fingerprints as one class: rep is the smallest doc_id."""
    return fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text): the smallest doc_id reachable by links of at most max_bits bits.

    Null, empty or blank texts have fingerprint zero and link like any other. Equal fingerprints (copies, repeated rows) are one
    class and never paired. A null doc_id joins its class, and is its own component (null) if the class has no other id. Extra
    columns are ignored; empty input gives no rows.
    """
    fps = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(classes_of(fps), "classes")
    comp = components(close_links(classes.where("rep is not null"), max_bits))
    label = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


# ---- similarity of 0.8 or more on sets of five-word shingles: the pipeline's near-duplicate stage ----

#: Minima of a band; share of pairs at the least similarity that the bands may miss.
BAND, MISS = 4, 1e-5
#: 64-bit lanes of a set's fingerprint; bytes of a group, and groups of its positional bytes that key lists, each byte in two.
LANES, GROUP, GROUPS = 8, 4, 32
#: Share of pairs at the least similarity that the count of shared bytes may rule out.
UNCOUNTED = 1e-4
_LANE = np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(20).integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)


def band_count(similarity: float) -> int:
    """Bands of BAND minima of which a pair at this similarity shares one but for a share MISS of pairs."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be 0.5 to 1: below it the bands get too many")
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-min(similarity, 0.999) ** BAND))))


def least_equal(similarity: float, n: int) -> int:
    """Equal minima of n that a pair at this similarity has at least, five deviations allowed."""
    return int(n * similarity - 5 * np.sqrt(n * similarity * (1 - similarity)))


@functools.cache
def byte_groups() -> np.ndarray:
    """GROUPS groups of GROUP of the 8 * LANES byte positions, dealt twice in different orders."""
    rng, per = np.random.default_rng(9), GROUPS * GROUP // (8 * LANES)
    at = np.concatenate([rng.permutation(8 * LANES) for _ in range(per)])
    return at.reshape(GROUPS, GROUP)


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    """fingerprint(h, LANES) as an array, all lanes at once."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), 4096):
        x = mixed(h[at : at + 4096, None] + _LANE)
        x[:, 0] = h[at : at + 4096]
        v = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(v), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(v[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)


def byte_keys(fp: np.ndarray) -> list[int]:
    """One long per group of positional bytes of a fingerprint."""
    b = fp.view(np.uint8)[byte_groups()].astype(np.int64)
    return (b << (8 * np.arange(GROUP))).sum(axis=1).tolist()


def bit_apart(similarity: float) -> float:
    """Share of the bits in which fingerprints of sets of one size at this similarity differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def least_shared(similarity: float) -> int:
    """Positional bytes that fingerprints at this similarity share but for a share UNCOUNTED of pairs."""
    n, p = 8 * LANES, (1 - bit_apart(similarity)) ** 8
    below, k = (1 - p) ** n, 0
    while below <= UNCOUNTED:
        k += 1
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def most_apart(similarity: float) -> int:
    """Bits in which fingerprints at this similarity differ at most, five deviations allowed."""
    n, p = 64 * LANES, bit_apart(similarity)
    return int(n * p + 5 * np.sqrt(n * p * (1 - p)))


def minima(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the hashes under each of n multiplications; repeated hashes count once by nature."""
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(out, (h[at : at + 1024, None] * _ODD[None, :n]).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One long per band of BAND minima."""
    x, k = least.reshape(-1, BAND), np.zeros(len(least) // BAND, np.uint64)
    for i in range(BAND):
        k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + x[:, i])
    return k.view(np.int64)


def sets(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(doc_id, text_hash, node, keys, bytes, sketch, fp): node is a hash of the text's set of shingles, keys its bands, fp its
    fingerprint of LANES lanes, bytes the keys of that, sketch a byte of each minimum. Texts without a word have no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, nodes, keys, parts, sketch, fps = b.slice(at, 512), [], [], [], [], []
                for t in part.column(2):
                    h = np.unique(shingle_hashes(t.as_py(), words))
                    m = minima(h, bands * BAND)
                    nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)))
                    keys.append(band_keys(m) if len(h) else [])
                    fp = set_fingerprint(h)
                    parts.append(byte_keys(fp) if len(h) else [])
                    fps.append(fp.tobytes())
                    sketch.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "text_hash", "node", "keys", "bytes", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, keys array<long>, bytes array<long>, sketch binary, fp binary")


def jaccard(a: str | None, b: str | None, words: int) -> float:
    return _overlap(np.unique(shingle_hashes(a, words)), np.unique(shingle_hashes(b, words)))


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree in least places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in b.columns[2:])
                b = b.filter(pa.array((x == y).sum(axis=1) >= least))
            yield b.select(["a", "b"])

    side = lambda n: classes.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _counted(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose fingerprints share enough positional bytes, and then differ in few enough bits, to be so similar."""
    shared, apart = least_shared(similarity), most_apart(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in b.columns[2:])
                ok = (x == y).sum(axis=1) >= shared
                ok[ok] = np.bitwise_count(x[ok] ^ y[ok]).sum(axis=1, dtype=np.int64) <= apart
                b = b.filter(pa.array(ok))
            yield b.select(["a", "b"])

    side = lambda n: classes.select(F.col("node").alias(n), F.col("fp").alias(f"f{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs (a, b) whose texts' shingle sets have a Jaccard similarity of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = functools.lru_cache(64)(lambda t: np.unique(shingle_hashes(t, words)))
        for b in batches:
            ok = pa.array([_overlap(own(x.as_py()), own(y.as_py())) >= least for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(ok)

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _bits(texts: DataFrame, words: int) -> DataFrame:
    """(node, size, bits) of (node, text): the number of distinct shingles and their bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hs = [np.unique(shingle_hashes(t.as_py(), words)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in hs], pa.int32()), pa.array([bits_of(h).tobytes() for h in hs], pa.binary())], names=["node", "size", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, size int, bits binary")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, list_limit: int = 48) -> DataFrame:
    """(doc_id, component_id) by links of texts whose sets of so many-word shingles have a Jaccard similarity of 0.8 or more.

    Texts with equal sets are one class. Fingerprints of the sets are indexed by groups of their positional bytes; pairs that share
    a group are kept if they share enough bytes in all, then if few enough bits differ. That finds most links of close copies and
    fewer the less alike they are, so further lists are keyed by bands of four minima over the distinct shingles, as many bands as
    leave MISS of the pairs at the least similarity without a shared list: whatever the bytes leave out comes by them. A byte of
    each minimum rules out pairs far below the similarity.
    Each class is first compared with the class of most documents in its lists, and only links verified on the texts settle
    anything: then all pairs of a list that these links leave in different components are compared. In the bands' lists of more
    than list_limit classes bit sets of the shingles, which never rule out a link, are compared in blocks first; each class meets
    the nearest other that they allow, and only then all that are left in different components; the pairs of longer lists of bytes
    are left to the bands. Null, empty and blank texts are equal to each other and to nothing else. Links are exact; recall is
    statistical (in the README).
    """
    bands = band_count(similarity)
    least = least_equal(similarity, bands * BAND)
    fps = staged(sets(docs, words, bands), "sets")
    classes = staged(fps.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("keys", "bytes", "sketch", "fp")], F.min("text_hash").alias("text_hash")), "classes")
    nodes = staged(fps.select("doc_id", "node"), "nodes")
    drop_staged(fps)
    slots = F.concat("bytes", "keys")  # slots below GROUPS are bytes, the others bands
    lists = posting_lists(classes.select("node", "weight", F.posexplode(slots).alias("slot", "key")), ["slot", "key"])
    ids = staged(lists.select("node").distinct().join(classes.select("node", "text_hash"), "node"), "ids")
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).join(ids, "text_hash").dropDuplicates(["node"]).select("node", "text")
    texts = staged(texts, "texts")  # every later step reads these alone, not all texts again

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (slot, a, b) those that their counts allow."""
        near = _counted(pairs.where(F.col("slot") < GROUPS).select("a", "b").distinct(), classes, similarity)
        return _alike(near.union(pairs.where(F.col("slot") >= GROUPS).select("a", "b")).distinct(), classes, least)

    hub = lists.groupBy("slot", "key").agg(F.min(F.struct(-F.col("weight"), "node")).alias("h")).select("slot", "key", F.col("h.node").alias("h"))
    first = staged(likely(lists.join(hub, ["slot", "key"]).where("node <> h").select("slot", F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b"))), "first")
    links = staged(_verified(first, texts, words, similarity), "verified")

    def still_open(comp: DataFrame) -> DataFrame:
        named = lists.where("n > 2").join(comp, "node", "left").select("slot", "key", "n", "node", F.coalesce("component", "node").alias("component"))
        ends = named.groupBy("slot", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("slot", "key")
        return staged(named.join(ends, ["slot", "key"], "left_semi"), "open")

    comp = components(links)
    open_ = still_open(comp)
    short = open_.where(F.col("n") <= list_limit)
    side = lambda n: short.select("slot", "key", F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    few = likely(side("a").join(side("b"), ["slot", "key"]).where("a < b and ca <> cb").select("slot", "a", "b"))
    longer = lambda o: o.where((F.col("n") > list_limit) & (F.col("slot") >= GROUPS))
    long_ = longer(open_)
    bits = staged(_bits(texts.join(long_.select("node").distinct(), "node", "left_semi"), words), "bits")
    near = near_in_lists(long_, bits, similarity, best=True)
    rest = staged(few.union(near).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    links, comp = grown(links, comp, staged(_verified(rest, texts, words, similarity), "links"))
    last = near_in_lists(longer(still_open(comp)), bits, similarity, best=False)
    last = staged(last.join(first.union(rest), ["a", "b"], "left_anti"), "last")
    _, comp = grown(links, comp, staged(_verified(last, texts, words, similarity), "last_links"))
    label = classes.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    label = staged(label, "labels")
    drop_staged(classes, lists, ids, texts, first, open_, bits, rest, last)
    label = label.join(label.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
    return nodes.join(label, "node").select("doc_id", "component_id")
