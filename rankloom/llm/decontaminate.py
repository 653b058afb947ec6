"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows scans each text once, and what it
finds is given as offsets into the original text."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

#: Bytes that are not part of a word: all ASCII but digits and letters. Also maps A-Z to a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Bytes of benchmark text that one automaton holds (it takes about 90 times as much memory); a larger benchmark goes in parts.
MAX_AUTOMATON_BYTES = 2 << 20
SPAN = "struct<start_word:int,end_word:int,start:int,end:int>"
SCHEMA = f"doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, hit_spans array<{SPAN}>"


def norm_bytes(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z lower-cased and a space for each byte outside words; as long as the text's own UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""


def norm_words(text: str | None) -> list[bytes]:
    """Lower-cased words; only A-Z is folded, and every byte of a non-ASCII character belongs to a word."""
    return norm_bytes(text).split()


def windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


class Benchmark:
    """An automaton over words: each word of the benchmark is a letter, any other word is letter 0."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = 13) -> None:
        self.letters: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            coded = [self.letters.setdefault(w, len(self.letters) + 1) for w in norm_words(text)]
            for w in windows(coded, size):
                of = found.setdefault(w, [])
                if not of or of[-1] != str(item):
                    of.append(str(item))
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, of in found.items():
            self.auto.add_word(w, (len(w), of))
        if found:
            self.auto.make_automaton()
        #: Words of the shortest window, and the pairs of neighbours that windows have.
        self.least, self.base = min(map(len, found), default=0), len(self.letters) + 1
        self.pairs = np.array(sorted({a * self.base + b for w in found for a, b in zip(w, w[1:], strict=False)}) or [-1], np.int64)

    def _parts(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Where windows can lie: runs of neighbours that are neighbours in the benchmark, as long as its shortest window."""
        if self.least < 2:
            return [(0, len(codes))]
        pair = codes[:-1] * self.base + codes[1:]
        known = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a + 1 >= self.least]

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items found."""
        words = norm_words(text)
        hit, items = np.zeros(len(words), bool), set()
        if words and len(self.auto):
            letter = self.letters.get
            codes = np.fromiter((letter(w, 0) for w in words), np.int64, len(words))
            for a, b in self._parts(codes):
                for last, (n, of) in self.auto.iter(tuple(codes[a:b].tolist())):
                    hit[a + last - n + 1 : a + last + 1] = True
                    items.update(of)
        return len(words), hit, items


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """The runs of hit words as word numbers and as character offsets into the original text (ends exclusive)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    if not len(edge):
        return []
    at = np.array([m.span() for m in _WORD.finditer(norm_bytes(text))])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters that begin before each byte
    return [{"start_word": int(a), "end_word": int(b), "start": int(chars[at[a, 0]]), "end": int(chars[at[b - 1, 1]])} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_BUILT: dict[str, Benchmark] = {}


def _built(token: str, items: list[tuple[object, str | None]], size: int) -> Benchmark:
    """The automaton of this token: built once in a Python worker, where only the latest is kept."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Benchmark(items, size)
    return _BUILT[token]


def _scanned(docs: DataFrame, items: list[tuple[object, str | None]], window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, item_ids, hit_spans) of docs (doc_id, text_hash, text)."""
    shared, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _built(token, shared.value, window)
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start_word", "end_word", "start", "end")]))
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(2):
                text = t.as_py()
                n, hit, found = bench.scan(text)
                got = sorted(found)
                for c, v in zip(cols, (n, int(hit.sum()), len(got), got, spans(text, hit) if got else []), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], kind)], names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "item_ids", "hit_spans"])

    return docs.mapInArrow(run, SCHEMA.replace("doc_id long,", "doc_id long, text_hash string,"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, most: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit (words inside any benchmark window), n_items, item_ids, hit_spans.

    hit_spans are the runs of hit words: word numbers and character offsets into the original text, ends exclusive. Null or empty
    text: no words, no hits. Null items have no windows; repeated items give the same windows once per id. Rows keep their
    multiplicity; extra columns are ignored. An empty benchmark hits nothing, empty docs give no rows.

    The benchmark's size is looked at first. Up to most bytes it is broadcast, and each Python worker builds one automaton. A
    larger one is dealt in parts by a hash: each part's automaton scans all texts, only texts with hits are kept, by a 128-bit
    hash of the text, and their spans are joined and added up. Both ways give the same rows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    gather = lambda of: [(r[0], r[1]) for r in of.orderBy("item_id", "text").collect()]  # noqa: E731  at most about most bytes
    if total <= most:
        return _scanned(rows.withColumn("text_hash", F.lit(None).cast("string")), gather(items), window).drop("text_hash")
    parts = math.ceil(1.25 * total / most)
    kept = []
    for k in range(parts):
        own = gather(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k))
        kept.append(staged(_scanned(rows, own, window).where("n_items > 0").select("text_hash", "item_ids", "hit_spans").dropDuplicates(["text_hash"]), f"part{k}"))
    hits = kept[0]
    for more in kept[1:]:
        hits = hits.union(more)
    hits = staged(_merged(hits), "hits")
    drop_staged(*kept)
    plain = _scanned(rows, [], window).select("doc_id", "text_hash", "n_words")
    out = plain.join(hits.withColumnRenamed("text_hash", "h"), F.col("text_hash") == F.col("h"), "left")
    count = F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["start_word"]), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", count.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("hit_spans", F.array().cast(f"array<{SPAN}>")).alias("hit_spans"))


def _merged(hits: DataFrame) -> DataFrame:
    """One row a text: all its items, and spans that overlap or touch (by word) as one. As many rows a text as there are parts."""
    grouped = hits.groupBy("text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("found"))

    def add(done, s):  # noqa: ANN001, ANN202
        last = F.element_at(done, -1)
        joined = F.struct(last["start_word"].alias("start_word"), F.greatest(last["end_word"], s["end_word"]).alias("end_word"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start_word"] <= last["end_word"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return grouped.select("text_hash", "item_ids", F.aggregate("found", F.array().cast(f"array<{SPAN}>"), add).alias("hit_spans"))


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds contaminated: some word is hit, and at least one word in twenty."""
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
