"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, thresholds calibrated by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_staged, staged, word_hashes

#: Bounds of the training sample: this many rows of either label at most, of at most so many words each. Scoring and the
#: calibration of thresholds have no bounds.
MAX_ROWS, MAX_WORDS = 6_000, 4_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
#: Words scored at a time; longer texts go in overlapping pieces whose maxima are combined.
PIECE = 1 << 14


@dataclass
class Model:
    emb: np.ndarray
    filters: list[np.ndarray]  # (width, DIM, FILTERS) each
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float]


def word_ids(text: str | None) -> np.ndarray:
    return (word_hashes((text or "").encode("utf-8", "surrogatepass"), letters=True) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def _windows(m: Model, ids: np.ndarray) -> np.ndarray:
    """Filter outputs before the bias at each position of ids (0: padding), all widths side by side."""
    x = np.concatenate([m.emb[ids], np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
    outs = []
    for f in m.filters:
        y = x[: len(ids)] @ f[0]
        for j in range(1, len(f)):
            y += x[j : j + len(ids)] @ f[j]
        outs.append(y)
    return np.concatenate(outs, axis=1)


def _pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each followed by padding, and where each starts."""
    gap = np.zeros(max(WIDTHS) - 1, np.int32)
    flat = np.concatenate([p for d in docs for p in (d, gap)])
    return flat, np.cumsum([0, *[len(d) + len(gap) for d in docs[:-1]]])


def _logit(m: Model, top: np.ndarray) -> np.ndarray:
    return np.maximum(top + np.concatenate(m.bias), 0) @ m.out + m.out_bias


def score_ids(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Scores of 0 to 1 for texts as word ids, empty ones included."""
    return _share(logits(m, docs))


def _share(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Log odds for texts as word ids, empty ones included."""
    scores = np.empty(len(docs))
    short = [i for i, d in enumerate(docs) if len(d) <= PIECE]
    at = 0
    while at < len(short):
        end, n = at, 0
        while end < len(short) and (end == at or n + len(docs[short[end]]) <= PIECE):
            n += len(docs[short[end]])
            end += 1
        flat, starts = _pad([docs[i] for i in short[at:end]])
        scores[short[at:end]] = _logit(m, np.maximum.reduceat(_windows(m, flat), starts, axis=0))
        at = end
    for i in set(range(len(docs))) - set(short):
        d = np.concatenate([docs[i], np.zeros(max(WIDTHS) - 1, np.int32)])
        tops = [_windows(m, d[a : a + PIECE + max(WIDTHS) - 1])[:PIECE].max(axis=0) for a in range(0, len(docs[i]), PIECE)]
        scores[i] = _logit(m, np.max(tops, axis=0)[None])[0]
    return scores


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Model:
    """Logistic loss, Adagrad; only the positions that win the max pooling carry gradients.

    The first place of each word's embedding starts as the smoothed log odds of the label among texts with the word, and the
    first filter of each width reads it; all else starts at random.
    """
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = Model(f32(BUCKETS, DIM, scale=0.3), [f32(w, DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f32(FILTERS * len(WIDTHS), scale=0.2), 0.0, {})
    seen = np.zeros((2, BUCKETS), np.float32)
    for d, y in zip(docs, labels, strict=True):
        seen[int(y > 0), np.unique(d)] += 1
    n_yes, n_no = float((labels > 0).sum()), float((labels <= 0).sum())
    m.emb[:, 0] = np.log((seen[1] + 5 * n_yes / (n_yes + n_no + 1)) / (n_yes + 1)) - np.log((seen[0] + 5 * n_no / (n_yes + n_no + 1)) / (n_no + 1)) if n_yes and n_no else 0
    for f in m.filters:
        f[:, :, 0] *= 0.1
        f[:, 0, 0] = 1.0 / len(f)
    m.out[::FILTERS] = 0.5
    m.emb[0] = 0
    rate_of = max(1e-3, float(labels.mean())) if len(labels) else 0.5
    m.out_bias = float(np.log(rate_of / max(1e-3, 1 - rate_of)))
    acc = {"emb": np.full((BUCKETS, 1), 1e-3, np.float32), "out": np.full(len(m.out), 1e-3, np.float32), "ob": 1e-3}
    acc_f, acc_b = [np.full_like(f, 1e-3) for f in m.filters], [np.full_like(b, 1e-3) for b in m.bias]
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            flat, starts = _pad([docs[i] for i in pick])
            win = _windows(m, flat)
            ends = np.append(starts[1:], len(flat))
            best = np.stack([s + win[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
            top = win[best, np.arange(win.shape[1])]
            pre = top + np.concatenate(m.bias)
            act = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.out_bias, -30, 30)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            g_out, g_ob = act.T @ g, float(g.sum())
            g_pre = g[:, None] * m.out * (pre > 0)
            g_emb_at, g_emb = [], []
            for k, f in enumerate(m.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                gk, at = g_pre[:, cols], best[:, cols]
                g_f = np.empty_like(f)
                for j in range(len(f)):
                    where = np.minimum(at + j, len(flat) - 1)
                    ids = np.where(at + j < len(flat), flat[where], 0)
                    g_f[j] = np.einsum("bfd,bf->df", m.emb[ids], gk)
                    g_emb_at.append(ids.ravel())
                    g_emb.append((gk[..., None] * f[j].T[None]).reshape(-1, DIM))
                acc_f[k] += g_f**2
                f -= rate * g_f / np.sqrt(acc_f[k])
                g_b = gk.sum(axis=0)
                acc_b[k] += g_b**2
                m.bias[k] -= rate * g_b / np.sqrt(acc_b[k])
            ids, inverse = np.unique(np.concatenate(g_emb_at), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(g_emb))
            acc["emb"][ids] += (total**2).mean(axis=1, keepdims=True)
            m.emb[ids] -= rate * total / np.sqrt(acc["emb"][ids])
            m.emb[0] = 0
            acc["out"] += g_out**2
            m.out -= rate * g_out / np.sqrt(acc["out"])
            acc["ob"] += g_ob**2
            m.out_bias -= rate * g_ob / acc["ob"] ** 0.5
    return m


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 40) -> dict[str | None, float]:
    """For each language with enough rows of either label the threshold with the best F1 (the middle of the best scores' gap);
    under key None that of all rows, for other languages. 0.5 where a label is missing."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        if y.sum() < 5 or (1 - y).sum() < 5:
            return 0.5
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(len(y)) + 1 + y.sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal scores
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)

    out: dict[str | None, float] = {None: best(scores, labels)}
    names = np.array([x or "" for x in langs])
    for lang in sorted(set(names) - {""}):
        of = names == lang
        if of.sum() >= least:
            out[lang] = best(scores[of], labels[of])
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from rows of docs (doc_id, text, lang) that labels (doc_id, toxic) covers.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are read. Remainders 2 to 4 are learnt from, at most MAX_ROWS of either
    label (the smallest seeded hashes of doc_id) of at most MAX_WORDS words; the bias is then set to the labels' rate over all
    such rows. Remainder 1 is left out of training: all its labelled rows, whole, move the bias so that a score of 0.5 gives the
    best F1, and calibrate the thresholds, for which alone lang serves. They are scored on the executors; log odds, label and
    language of each come to the driver. Epochs and rate were chosen on remainders 1 to 4: learnt on 3 and 4, judged on 2. Null
    labels are ignored; a doc_id with several labels takes the largest.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(fold != 0)
    marks = staged(marks.where(fold != 0), "marks")
    some = lambda which: marks.where(which).where(fold != 1).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(MAX_ROWS)
    chosen = some("toxic > 0").union(some("toxic <= 0"))
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # 2 * MAX_ROWS narrow rows

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [word_ids(t.as_py()) for t in b.column(1)]
            keep = pa.array([len(x) <= MAX_WORDS for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32())), *b.columns[2:]], names=["doc_id", "ids", "toxic"]).filter(keep)

    got = sample.mapInArrow(ids, "doc_id long, ids array<int>, toxic int").toArrow()
    flat = got.column("ids").combine_chunks()  # the words stay in Arrow's buffers: no list of numbers on the driver
    words, at = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    texts = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    doc, toxic = (got.column(c).to_numpy() for c in ("doc_id", "toxic"))
    order = np.lexsort(([int(t.sum(dtype=np.int64)) for t in texts], [len(t) for t in texts], doc)) if texts else np.empty(0, np.int64)
    marked = (toxic > 0).astype(np.float32)
    m = train([texts[i] for i in order], marked[order])
    share = marks.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    mine = float(marked.mean()) if len(order) else 0.5
    del got, flat, words, texts, doc, toxic, order
    pa.default_memory_pool().release_unused()
    if share and 0 < share < 1 and 0 < mine < 1:
        m.out_bias += float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([pa.array(logits(shared.value, [word_ids(t.as_py()) for t in part.column(0)]), pa.float64()), *part.columns[1:]], names=["odds", "toxic", "lang"])

    held = rows.where(fold == 1).join(marks.where(fold == 1), "doc_id").select("text", "toxic", "lang")
    held = held.mapInArrow(odds, "odds double, toxic int, lang string").toArrow()
    shared.destroy()
    drop_staged(marks)
    if len(held):
        x, y, spoken = held.column("odds").to_numpy(), (held.column("toxic").to_numpy() > 0).astype(float), held.column("lang").to_pylist()
        cut = calibrate(_share(x), y, spoken)[None]
        if 0 < cut < 1:
            shift = float(np.log(cut / (1 - cut)))  # a score of 0.5 is the best threshold for all languages together
            m.out_bias, x = m.out_bias - shift, x - shift
        m.thresholds = calibrate(_share(x), y, spoken)
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, lang, and any others) with held_out, score, predicted, threshold and flagged added; whole texts.

    Null and empty texts have a score as well. predicted is 1 at a score of 0.5 or more; flagged holds the score against the
    threshold of the row's lang (other or null lang: that of all). Rows keep their multiplicity; empty docs give no rows. Input
    columns other than doc_id, text and lang come back within the struct column row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for a in range(0, max(1, b.num_rows), 256):
                part = b.slice(a, 256)
                s = score_ids(m, [word_ids(t.as_py()) for t in part.column("text")]) if part.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*part.schema.names, "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "lang")], F.lit(True).alias("there_")).alias("row"))
    out = base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))
    limits = {k: v for k, v in model.thresholds.items() if k is not None}
    threshold = F.lit(model.thresholds.get(None, 0.5))
    for lang, v in sorted(limits.items()):
        threshold = F.when(F.col("lang") == lang, F.lit(v)).otherwise(threshold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))
