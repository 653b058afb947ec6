"""Tables beside an index: metadata by key, the document and query embedding caches, and the query history."""

from __future__ import annotations

import hashlib
import hmac
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.sources import fs


class _Versions:
    """A table whose folder holds whole versions, and a file that names the one that counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        at = fs.read_text(self.spark, f"{self.path}/current")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        """The version before stays until the next one, so that running readers end."""
        old, new = fs.read_text(self.spark, f"{self.path}/current"), f"v={uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{new}")
        fs.write_text(self.spark, f"{self.path}/current", new)
        for n in fs.names(self.spark, self.path):
            if n.startswith("v=") and n not in (old, new):
                fs.delete(self.spark, f"{self.path}/{n}")


class Metadata(_Versions):
    """Values (JSON text) by key. Changes wait until commit(); a batch of changes is one DataFrame, not a call a row."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, "key string, value string")
        self._put: DataFrame | None = None
        self._gone: DataFrame | None = None

    def put(self, rows: DataFrame) -> None:
        """rows (key, value); of a key's several rows in one batch the largest value counts."""
        new = rows.groupBy("key").agg(F.max("value").alias("value"))
        self._put = new if self._put is None else self._put.join(new.select("key"), "key", "left_anti").unionByName(new)

    def remove(self, keys: DataFrame) -> None:
        self._gone = keys.select("key") if self._gone is None else self._gone.union(keys.select("key"))
        self._put = None if self._put is None else self._put.join(keys.select("key"), "key", "left_anti")

    def commit(self) -> None:
        df = self.read()
        if self._gone is not None:
            df = df.join(self._gone.distinct(), "key", "left_anti")
        if self._put is not None:
            df = df.join(self._put.select("key"), "key", "left_anti").unionByName(self._put)
        self.replace(df.sort("key"))
        self._put = self._gone = None

    def get(self, key: str) -> str | None:
        row = self.read().where(F.col("key") == key).select("value").first()
        return row.value if row else None

    def __contains__(self, key: str) -> bool:
        return bool(self.read().where(F.col("key") == key).limit(1).count())

    def __len__(self) -> int:
        return self.read().count()


class EmbeddingCache(_Versions):
    """Vectors by sha256 of the text, provider, model and mode; the oldest go where there are more than most."""

    def __init__(self, spark: SparkSession, path: str, most: int = 200_000) -> None:
        super().__init__(spark, path, "key string, provider string, model string, mode string, v array<float>, created_at double")
        self.most = most

    def of(self, provider: str, model: str, mode: str) -> DataFrame:
        return self.read().where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("mode") == mode))

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows written beside the versions and read back; they stay until the next but one call."""
        made = sorted((n for n in fs.names(self.spark, self.path) if n.startswith("fresh=")), key=lambda n: int(n[6:].split("-")[0]))
        for n in made[:-1]:
            fs.delete(self.spark, f"{self.path}/{n}")
        at = f"{self.path}/fresh={time.time_ns()}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def add(self, rows: DataFrame, provider: str, model: str, mode: str) -> bool:
        """rows (key, v); a key that is there already is replaced. Whether any row of the cache had to go."""
        new = rows.dropDuplicates(["key"]).select("key", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(mode).alias("mode"), F.col("v").cast("array<float>").alias("v"), F.lit(time.time()).alias("created_at"))
        both = self.read().join(new.select("key", "provider", "model", "mode"), ["key", "provider", "model", "mode"], "left_anti").unionByName(new)
        over = both.count() > self.most
        self.replace(self.evicted(both) if over else both)
        return over

    def evicted(self, rows: DataFrame) -> DataFrame:
        """The newest most rows. Times are counted first, and only rows of the one time at the border are put in order."""
        times = rows.groupBy("created_at").agg(F.count("*").alias("n"))  # one row a batch that was added
        newer = F.coalesce(F.sum("n").over(W.orderBy(F.desc("created_at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        times = times.withColumn("newer", newer)
        j = rows.join(F.broadcast(times), "created_at")  # checked by what a cache is: batches are few beside rows
        whole = j.where(F.col("newer") + F.col("n") <= self.most)
        border = j.where((F.col("newer") < self.most) & (F.col("newer") + F.col("n") > self.most))
        cut = border.orderBy("key", "provider", "model", "mode").withColumn("nth", F.row_number().over(W.partitionBy("created_at").orderBy("key", "provider", "model", "mode"))).where(F.col("nth") + F.col("newer") <= self.most)
        return whole.unionByName(cut.drop("nth")).drop("n", "newer")


class QueryCache:
    """Vectors of queries on the driver, by the trimmed lower-cased text: the latest used most of them."""

    def __init__(self, embed: Callable[[str], list[float]], most: int = 256) -> None:
        self.embed, self.most, self.held, self.hits = embed, most, OrderedDict(), 0

    def get(self, query: str) -> list[float]:
        key = query.strip().lower()
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
        else:
            self.held[key] = self.embed(query.strip())
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]

    def clear(self) -> None:
        self.held.clear()


HISTORY = "ts double, query_hash string, query string, project_hash string, mode string, k int, n_results int, latency_ms double, freshness string, reranker string, reason string, generation string, error string"


def digest(text: str, secret: bytes) -> str:
    """HMAC-SHA256, so that a history without texts still tells equal queries."""
    return hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()


class History(_Versions):
    """Query history in modes off, metadata (no query text) and full; entries older than keep_days go when one is added."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "off", secret: bytes = b"", keep_days: float = 30.0) -> None:
        if mode not in ("off", "metadata", "full"):
            raise ValueError("mode must be off, metadata or full")
        super().__init__(spark, path, HISTORY)
        self.mode, self.secret, self.keep_days = mode, secret, keep_days

    def record(self, entries: list[dict], at: float | None = None) -> int:
        """entries: dicts with query, project and any of the other columns. Entries written; none in mode off."""
        if self.mode == "off" or not entries:
            return 0
        now = time.time() if at is None else at
        cols = [c.split()[0] for c in HISTORY.split(", ")]
        rows = []
        for e in entries:
            own = {"ts": now, "query_hash": digest(e.get("query", ""), self.secret), "project_hash": digest(e.get("project", ""), self.secret), "query": e.get("query") if self.mode == "full" else None}
            rows.append(tuple((e | own).get(c) for c in cols))
        new = self.spark.createDataFrame(rows, HISTORY)
        self.replace(self.read().where(F.col("ts") >= now - 86400 * self.keep_days).unionByName(new))
        return len(rows)


def redacted(message: str, query: str, secret: bytes) -> str:
    """A log message with the query's text replaced by the start of its digest and its length."""
    return message.replace(query, f"<query {digest(query, secret)[:12]}, {len(query)} characters>") if query else message
