"""Embedding: a registry of providers, cached and batched calls over DataFrames, retries, grouped and asynchronous batches.

A provider is a function of a list of texts to vectors, built once in a Python worker from its settings; clients of remote
services are given by the caller. hashed-words needs none and is deterministic.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import chunking, records
from rankloom.sources.tables import EmbeddingCache

Encode = Callable[[list[str]], list[list[float]]]
PROVIDERS: dict[str, Callable[..., Encode]] = {}
# Replies worth another attempt, attempts, texts and tokens a request, and bounds of grouped requests.
RETRY_STATUS = (429, 500, 502, 503, 529)
ATTEMPTS, BATCH, REQUEST_TOKENS = 4, 256, 100_000
GROUP_TOKENS, GROUPED_TOKENS, GROUPED_INPUTS = 30_000, 100_000, 500
#: Texts in a line of an asynchronous batch.
LINE_TEXTS = 128


def provider(name: str) -> Callable:
    """Registers a factory: settings -> Encode."""

    def add(f: Callable[..., Encode]) -> Callable[..., Encode]:
        PROVIDERS[name] = f
        return f

    return add


def resolved(explicit: str | None, stored: str | None, env: str | None, default: str = "hashed-words") -> str:
    """The provider's name: explicit, else the index's own, else the environment's, else the default; unknown names are errors."""
    name = next((x.strip().lower() for x in (explicit, stored, env) if x and x.strip()), default)
    if name not in PROVIDERS:
        raise LookupError(f"unknown embedding provider {name}: {sorted(PROVIDERS)}")
    return name


@provider("hashed-words")
def hashed_words(dim: int = 64, **_) -> Encode:
    """Signed hashes of the folded words, at length 1."""
    from rankloom.operators.lexical import folded

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in folded(t or ""):
                h = xxhash.xxh64_intdigest(w, 7)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return encode


@provider("local-model")
def local_model(load: Callable[[], Callable[[list[str]], Iterable]] | None = None, batch: int = 32, **_) -> Encode:
    """A model loaded once a worker by load(), called with batch texts at a time."""
    if load is None:
        raise LookupError("a local model needs load")
    model = load()
    return lambda texts: [list(map(float, v)) for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]


class RemoteError(RuntimeError):
    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status


def attempted(call: Callable[[], object], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> object:
    """call(), again after 1, 2, 4 ... seconds where it raises RemoteError with a status worth it; the last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except RemoteError as e:
            if e.status not in RETRY_STATUS or n == attempts - 1:
                raise
            wait(float(2**n))
    raise AssertionError("attempts must be positive")


def token_estimate(text: str) -> int:
    return len(text) // 4


def by_tokens(texts: list[str], most: int = REQUEST_TOKENS, count: int = BATCH) -> list[list[str]]:
    """Consecutive texts in batches of at most count and most tokens; a longer text is a batch of its own."""
    out: list[list[str]] = []
    held = 0
    for t in texts:
        n = token_estimate(t)
        if not out or len(out[-1]) >= count or held + n > most:
            out.append([])
            held = 0
        out[-1].append(t)
        held += n
    return out


def grouped_batches(groups: list[list[str]], group_tokens: int = GROUP_TOKENS, most: int = GROUPED_TOKENS, inputs: int = GROUPED_INPUTS) -> list[list[list[str]]]:
    """Groups (a file's texts) in batches of at most inputs groups and most tokens; a group over group_tokens is cut first."""
    cut = [part for g in groups for part in (by_tokens(g, group_tokens, len(g)) if sum(map(token_estimate, g)) > group_tokens else [g])]
    out: list[list[list[str]]] = []
    held = 0
    for g in cut:
        n = sum(map(token_estimate, g))
        if not out or len(out[-1]) >= inputs or held + n > most:
            out.append([])
            held = 0
        out[-1].append(g)
        held += n
    return out


@provider("remote")
def remote(client: Callable[[list[str]], list[list[float]]] | None = None, batch: int = BATCH, wait: Callable[[float], None] = time.sleep, **_) -> Encode:
    """A remote service through client(texts) -> vectors, in batches by count and tokens, with retries; a short reply is an error."""
    if client is None:
        raise LookupError("a remote provider needs a client")

    def encode(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for part in by_tokens(texts, REQUEST_TOKENS, batch):
            got = attempted(lambda part=part: client(part), wait=wait)
            if len(got) != len(part):
                raise RemoteError(200, f"{len(part)} texts, {len(got)} vectors")
            out += [list(map(float, v)) for v in got]
        return out

    return encode


def encode_grouped(groups: list[list[str]], client: Callable[[list[list[str]]], list[list[list[float]]]], wait: Callable[[float], None] = time.sleep) -> list[list[list[float]]]:
    """Vectors of each group's texts, each made in the context of its group."""
    flat: list[list[float]] = []
    for part in grouped_batches(groups):
        got = attempted(lambda part=part: client(part), wait=wait)
        if [len(g) for g in got] != [len(g) for g in part]:
            raise RemoteError(200, "the reply's groups differ in size")
        flat += [list(map(float, v)) for g in got for v in g]
    rest = iter(flat)
    return [[next(rest) for _ in g] for g in groups]


def batch_lines(texts: list[str], model: str) -> list[str]:
    """An asynchronous batch's lines of JSON, LINE_TEXTS texts each, numbered by custom_id."""
    return [json.dumps({"custom_id": f"{i // LINE_TEXTS}", "body": {"model": model, "input": texts[i : i + LINE_TEXTS]}}, ensure_ascii=False) for i in range(0, len(texts), LINE_TEXTS)]


def batch_vectors(lines: Iterable[str], n: int) -> list[list[float]]:
    """The vectors of a batch's result lines, which come in any order, in the order of the texts; n of them, or an error."""
    parts = {}
    for line in lines:
        x = json.loads(line)
        if x.get("error"):
            raise RemoteError(int(x.get("status", 500)), str(x["error"]))
        parts[int(x["custom_id"])] = x["embeddings"]
    out = [v for k in sorted(parts) for v in parts[k]]
    if len(out) != n:
        raise RemoteError(200, f"{n} texts, {len(out)} vectors")
    return out


def embed_async(texts: list[str], submit: Callable[[list[str]], str], poll: Callable[[str], list[str] | None], model: str, most_polls: int = 1000, wait: Callable[[float], None] = time.sleep, every: float = 10.0) -> list[list[float]]:
    """submit(lines) -> job, poll(job) -> result lines once it is done; the texts' vectors in order."""
    job = submit(batch_lines(texts, model))
    for _ in range(most_polls):
        lines = poll(job)
        if lines is not None:
            return batch_vectors(lines, len(texts))
        wait(every)
    raise TimeoutError(f"job {job} did not end")


def embed(texts: DataFrame, name: str, batch: int = 1000, **settings) -> DataFrame:
    """(key, v) of texts (key, text); a worker builds the provider once and calls it with at most batch texts."""
    make = PROVIDERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make(**settings)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = encode(part.column(1).to_pylist())
                if len(v) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts, {len(v)} vectors")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v, pa.list_(pa.float32()))], names=["key", "v"])

    return texts.select(F.col("key").cast("string"), F.coalesce("text", F.lit(""))).mapInArrow(run, "key string, v array<float>")


def embed_cached(texts: DataFrame, cache: EmbeddingCache, name: str, model: str = "", mode: str = "document", **settings) -> DataFrame:
    """(id, v) of texts (id, text): distinct texts that the cache has not are embedded once and added to it.

    Every text gets its vector, also where there are more than the cache holds: those that it let go come from what was embedded
    and from its version before, which stay until it is next added to.
    """
    have = cache.of(name, model, mode).select("key", "v")
    misses = records.cache_misses(texts.where("text is not null"), cache.read(), name, model, mode)
    if misses.limit(1).count():
        fresh = cache.stage(embed(misses, name, **settings))
        have = have.unionByName(fresh) if cache.add(fresh, name, model, mode) else cache.of(name, model, mode).select("key", "v")
    keyed = texts.select("id", F.sha2("text", 256).alias("key"))
    return keyed.join(have, "key").select("id", "v")


def embed_grouped(chunks: DataFrame, client: Callable[[list[list[str]]], list[list[list[float]]]]) -> DataFrame:
    """(id, v) of chunks (id, path, start_line, text), each embedded in the context of its file; a task holds a file's texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_line", "id"])
        return pd.DataFrame({"id": pdf["id"], "v": encode_grouped([pdf["text"].fillna("").tolist()], client)[0]})

    return chunks.select("id", "path", "start_line", "text").groupBy("path").applyInPandas(run, "id long, v array<float>")


def siblings(chunks: DataFrame) -> DataFrame:
    """(path, names): the names of a file's chunks in order of their lines; chunks: path, start_line, name."""
    named = chunks.where(F.coalesce("name", F.lit("")) != "").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name"))).alias("t"))  # the chunks of one file
    return named.select("path", F.transform("t", lambda x: x["name"]).alias("names"))


def embedding_texts(chunks: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(id, text) that an embedder sees of chunks (id, path, kind, name, parent, docstring, start_line, text).

    The header names the file and the chunk, and for ...Props types the component that they are of; context (chunk_id, context), where
    it has a text that is not blank, takes the header's place. Sibling names, docstring and body follow (chunking.embedding_text).
    """
    j = chunks.join(siblings(chunks), "path", "left")
    head = F.concat_ws(" ", F.concat(F.lit("# "), F.col("path"), F.lit(":")), "kind", F.concat_ws(".", "parent", "name"))
    props = F.when(F.col("name").rlike("^[A-Z].*Props$"), F.concat(F.lit(" (props for "), F.regexp_replace("name", "Props$", ""), F.lit(")"))).otherwise("")
    head = F.concat(head, props)
    if context is not None:
        own = context.where(F.trim("context") != "").groupBy("chunk_id").agg(F.max("context").alias("context"))
        j = j.join(own, "chunk_id", "left")
        head = F.coalesce("context", head)
    others = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n != F.coalesce("name", F.lit("")))
    return j.select("id", chunking.embedding_text(head, F.col("docstring"), others, F.coalesce("text", F.lit(""))).alias("text"))


def dimension(value: str | int | None, allowed: tuple[int, ...] | None = None) -> int | None:
    """An output dimension as given (None: the model's own); an error if it is no positive integer or not one of those allowed."""
    if value is None or value == "":
        return None
    try:
        n = int(value)
    except ValueError:
        raise ValueError(f"output dimension {value!r} is no integer") from None
    if n <= 0 or (allowed and n not in allowed):
        raise ValueError(f"output dimension {n} is not one of {allowed}" if allowed else "output dimension must be positive")
    return n


def checked_dimension(v: Column, dim: int | None) -> Column:
    from rankloom.operators.vector import checked

    return v if dim is None else checked(v, dim)
