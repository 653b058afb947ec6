"""Building, refreshing, auditing and describing an index.

build() and refresh() return what was done as a dict; nothing is published unless all of it succeeded. Order: files are read and
hashed, changed files chunked and embedded, then rows replaced, the generation published, and the snapshot written last.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import chunking, embedding, lexical, records, search, vector
from rankloom.operators.search import Index
from rankloom.sources import files as source
from rankloom.sources import fs, store
from rankloom.sources.tables import EmbeddingCache

#: Stale share of an index at which a refresh rebuilds it, and at which the status advises it.
COMPACT, ADVISE = 0.5, 0.25
# Suffixes and the tags that statistics recomputed from paths give them.
TRUTH_TAGS = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust", ".go": "go", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".tf": "hcl", ".hcl": "hcl", ".nix": "nix", ".c": "c", ".h": "c"}


class EmptyIndex(ValueError):
    """Files that should have given chunks gave none."""


def chunk_rows(files: DataFrame) -> DataFrame:
    """The chunks table of files (path, text, hash): ids, previews, folders and languages beside what the chunkers give."""
    units = chunking.chunk_files(files.select("path", "text"))
    cid = X.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("name"))
    j = units.withColumn("chunk_id", cid).join(files.select("path", F.col("hash").alias("file_hash")), "path")
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = j.select(F.xxhash64("chunk_id").alias("id"), "chunk_id", "path", "kind", "name", "parent", "docstring", "start_line", "end_line", "text", "tags", X.preview(F.col("text")).alias("content_preview"), parts.alias("folder_structure"), chunking.language(F.col("path")).alias("language"), "file_hash")
    return rows.dropDuplicates(["chunk_id"])


def lexical_rows(chunks: DataFrame) -> DataFrame:
    """What the lexical arm indexes of chunks: their id, text behind its header, path and name."""
    return chunks.select("id", "chunk_id", F.concat(X.lexical_header(F.col("path"), F.col("kind"), F.col("parent"), F.col("name")), F.coalesce("text", F.lit(""))).alias("content"), "path", F.coalesce("name", F.lit("")).alias("name"))


def lexical_parts(chunks: DataFrame, analyser: str = "porter") -> tuple[DataFrame, DataFrame]:
    rows, analyse = lexical_rows(chunks), search.analyse(analyser)
    return lexical.build_postings(rows, search.LEXICAL_COLUMNS, analyse), lexical.corpus_stats(rows, search.LEXICAL_COLUMNS, analyse)


def in_memory(chunks: DataFrame, vectors: DataFrame | None, analyser: str = "porter") -> Index:
    """An index that is computed as it is read: chunks as chunk_rows() gives them. Its texts are scanned for what is asked."""
    postings, stats = lexical_parts(chunks, analyser)
    return Index(chunks, postings, stats, vectors, analyser, rows=lexical_rows)


def _read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Supported files with their text, and all files' hashes."""
    tree = source.walk(spark, root)
    return source.decoded(source.supported(tree)), source.file_hashes(tree)


def _vectors(chunks: DataFrame, cache: EmbeddingCache, provider: str, model: str, dim: int | None, settings: Mapping) -> DataFrame:
    v = embedding.embed_cached(embedding.embedding_texts(chunks), cache, provider, model, **settings)
    return v.select("id", embedding.checked_dimension(F.col("v"), dim).alias("v"))


def _publish(spark: SparkSession, root: str, chunks: DataFrame, vectors: DataFrame, analyser: str, force: bool, **facts) -> dict:
    postings, stats = lexical_parts(chunks, analyser)
    m = store.publish(spark, root, {"chunks": chunks, "postings": postings, "stats": stats, "vectors": vectors}, force, **facts)
    fs.write_json(spark, f"{root}/stats.json", {k: v for k, v in statistics(spark, root).items() if k in ("total_chunks", "live_chunks", "files_indexed", "index_type", "quantization")})
    return m


def build(spark: SparkSession, tree: str, root: str, provider: str = "hashed-words", model: str = "", dim: int | None = None, analyser: str = "porter", force: bool = True, pipeline: str = "1", **settings) -> dict:
    """A full build of a folder's index at root. No chunk at all of files that a chunker knows is an error, and so is an index whose
    vectors do not find themselves; a tree without such files gives an empty index. The last good index stays on any error."""
    known, hashes = _read(spark, tree)
    work = f"{root}/work"
    fs.delete(spark, work)
    try:
        hashes.write.parquet(f"{work}/hashes")
        hashes = spark.read.parquet(f"{work}/hashes")
        chunk_rows(known.where("error is null").join(hashes.select("path", "hash"), "path")).write.parquet(f"{work}/chunks")
        chunks = spark.read.parquet(f"{work}/chunks")
        n, attempted = chunks.count(), known.count()
        readable = known.where("error is null and trim(text) <> ''").limit(1).count()
        if not n and readable:
            raise EmptyIndex(f"{attempted} files gave no chunk")
        cache = EmbeddingCache(spark, f"{root}/cache")
        _vectors(chunks, cache, provider, model, dim, settings).write.parquet(f"{work}/vectors")
        vectors = spark.read.parquet(f"{work}/vectors")
        if vectors.count() != n:
            raise store.InconsistentManifest(f"{n} chunks, {vectors.count()} vectors")
        wrong = vector.searchable(vectors) if n else None
        if wrong:
            raise EmptyIndex(wrong)
        width = len(vectors.first().v) if n else 0
        m = _publish(spark, root, chunks, vectors, analyser, force, provider=provider, model=model, vector_dim=width, pipeline_version=pipeline)
        sid = store.save_snapshot(spark, root, hashes)
    finally:
        fs.delete(spark, work)
    return {"mode": "full", "epoch_id": m["epoch_id"], "snapshot_id": sid, "files_added": attempted, "files_removed": 0, "files_modified": 0, "chunks_added": n, "chunks_removed": 0}


def detect(spark: SparkSession, tree: str, root: str) -> DataFrame:
    """(path, change) since the newest snapshot; without one every file is added."""
    old = store.load_snapshot(spark, root)
    new = source.file_hashes(source.walk(spark, tree))
    return records.changes(old if old is not None else spark.createDataFrame([], "path string, hash string"), new)


def root_hash(files: DataFrame) -> str | None:
    """The hash of a tree of files (path, hash), by its directories; None for no files."""
    depth = files.agg(F.max(F.size(F.split("path", "/")))).first()[0]
    if not depth:
        return None
    row = records.directory_hashes(files.select("path", "hash"), depth).where("path = ''").first()
    return row.hash if row else None


def changed_directories(ch: DataFrame) -> DataFrame:
    """(path): the folders of files that changed; '.' is the top."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return ch.where("change <> 'unchanged'").select(folder.alias("path")).distinct()


def quick_check(spark: SparkSession, tree: str, root: str) -> bool:
    """Whether anything changed, by root hashes: a file renamed within its folder goes unseen, as hashes cover no names of files."""
    old = store.load_snapshot(spark, root)
    return old is None or root_hash(old) != root_hash(source.file_hashes(source.walk(spark, tree)))


def needs_refresh(spark: SparkSession, tree: str, root: str, minutes: float = 5.0) -> bool:
    """No snapshot, one older than minutes, or a changed tree."""
    age = store.snapshot_age_minutes(spark, root)
    return age is None or age > minutes or quick_check(spark, tree, root)


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those of the files gone (path): by the path where it is relative, and by its end after a slash where it is
    absolute (an equality join on every end of the absolute path, not a comparison of all with all)."""
    rel = gone.where(~F.col("path").startswith("/")).select(X.norm_path(F.col("path")).alias("path"))
    ends = gone.where(F.col("path").startswith("/")).select(F.split(X.norm_path(F.col("path")), "/").alias("p"))
    ends = ends.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("path"))
    return chunks.join(rel.union(ends).distinct(), "path", "left_anti")


def refresh(spark: SparkSession, tree: str, root: str, force: bool = False, dim: int | None = None, analyser: str = "porter", **settings) -> dict:
    """Brings an index up to date: only added and modified files are chunked and embedded.

    A full build where force is set, there is no snapshot or no sound current index, it is empty, or more than COMPACT of its
    rows would be stale. Nothing changed: nothing is written.
    """
    found = store.read_manifest(spark, root)
    index = store.load(spark, root, analyser)[0] if found.freshness == "fresh" else None
    facts = {k: (found.manifest or {}).get(k) for k in ("provider", "model", "pipeline_version")}
    provider, model = facts["provider"] or "hashed-words", facts["model"] or ""
    if force or index is None or index.vectors is None or store.load_snapshot(spark, root) is None:
        return build(spark, tree, root, provider, model, dim, analyser, pipeline=facts["pipeline_version"] or "1", **settings)
    work = f"{root}/work"
    fs.delete(spark, work)
    try:
        known, hashes = _read(spark, tree)
        hashes.write.parquet(f"{work}/hashes")
        hashes = spark.read.parquet(f"{work}/hashes")
        records.changes(store.load_snapshot(spark, root), hashes).write.parquet(f"{work}/changes")
        ch = spark.read.parquet(f"{work}/changes")
        n = {r.change: r["count"] for r in ch.groupBy("change").count().collect()}
        if not any(n.get(c) for c in ("added", "removed", "modified")):
            return {"mode": "none", "files_added": 0, "files_removed": 0, "files_modified": 0, "chunks_added": 0, "chunks_removed": 0}
        fresh_files = known.where("error is null").join(records.to_reindex(ch), "path", "left_semi").join(hashes.select("path", "hash"), "path")
        chunk_rows(fresh_files).write.parquet(f"{work}/chunks")
        fresh = spark.read.parquet(f"{work}/chunks")
        cache = EmbeddingCache(spark, f"{root}/cache")
        _vectors(fresh, cache, provider, model, dim or found.manifest["vector_dim"] or None, settings).write.parquet(f"{work}/vectors")
        kept = without_files(index.chunks, records.to_remove(ch))
        before, left, added = index.chunks.count(), kept.count(), fresh.count()
        if before - left > COMPACT * max(left + added, 1):
            return build(spark, tree, root, provider, model, dim, analyser, pipeline=facts["pipeline_version"] or "1", **settings)
        chunks = kept.select(fresh.columns).unionByName(fresh)
        vectors = index.vectors.join(kept.select("id"), "id", "left_semi").unionByName(spark.read.parquet(f"{work}/vectors"))
        m = _publish(spark, root, chunks, vectors, analyser, True, provider=provider, model=model, vector_dim=found.manifest["vector_dim"], pipeline_version=facts["pipeline_version"] or "1")
        sid = store.save_snapshot(spark, root, hashes)
    finally:
        fs.delete(spark, work)
    return {"mode": "incremental", "epoch_id": m["epoch_id"], "snapshot_id": sid, "files_added": n.get("added", 0), "files_removed": n.get("removed", 0), "files_modified": n.get("modified", 0), "chunks_added": added, "chunks_removed": before - left}


# ---- statistics and audit ----


def tag_counts(chunks: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent tags: (tag, n)."""
    return chunks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def counters(chunks: DataFrame, vectors: int | None = None) -> DataFrame:
    """One row: total_chunks, live_chunks, stale_vectors, files_indexed."""
    g = chunks.agg(F.count("*").alias("live_chunks"), F.countDistinct("path").alias("files_indexed"))
    total = F.col("live_chunks") if vectors is None else F.lit(vectors).cast("long")
    return g.select(F.col("live_chunks").alias("total_chunks"), "live_chunks", F.greatest(total - F.col("live_chunks"), F.lit(0)).alias("stale_vectors"), "files_indexed")


def truth_tag(path: Column) -> Column:
    """The tag that a path's suffix gives."""
    table = F.create_map(*[F.lit(x) for kv in TRUTH_TAGS.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def stats_from_truth(chunks: DataFrame, folders: int = 10, tags: int = 20) -> DataFrame:
    """(what, key, n): statistics recomputed from paths alone: the most frequent first parts of paths, tags by suffix, and kinds."""
    path = F.regexp_replace("path", r"\\", "/")
    keyed = chunks.select(F.explode(F.array(F.struct(F.lit("folder").alias("what"), F.split(path, "/")[0].alias("key")), F.struct(F.lit("tag").alias("what"), truth_tag(path).alias("key")), F.struct(F.lit("kind").alias("what"), F.col("kind").alias("key")))).alias("x")).select("x.*")
    g = keyed.where(F.coalesce("key", F.lit("")) != "").groupBy("what", "key").agg(F.count("*").alias("n"))
    most = F.when(F.col("what") == "folder", folders).when(F.col("what") == "tag", tags).otherwise(1 << 30)
    from rankloom.operators import fusion

    return fusion.ranked(g, ["what"], F.desc("n"), "key").where(F.col("rank") <= most).drop("rank")


def tree_stats(files: DataFrame) -> DataFrame:
    """One row: files, directories and bytes of a snapshot (path, hash, size)."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i - 1), "/"))
    dirs = files.select(F.explode(up).alias("d")).agg(F.countDistinct("d").alias("directories"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(dirs))  # one row


def statistics(spark: SparkSession, root: str) -> dict:
    """What an index holds: counters, top folders, kinds and tags, its dimension and how fresh its manifest is."""
    index, found = store.load(spark, root, verify=False)
    c = counters(index.chunks, None if index.vectors is None else index.vectors.count()).first().asDict()
    folders = {r.folder: r.n for r in records.folder_counts(index.chunks).collect()}
    kinds = {r.kind: r["count"] for r in index.chunks.groupBy("kind").count().collect()}
    tags = {r.tag: r.n for r in tag_counts(index.chunks).collect()}
    m = found.manifest or {}
    return c | {"top_folders": folders, "chunk_types": kinds, "top_tags": tags, "embedding_dimension": m.get("vector_dim", 0), "index_type": "flat", "quantization": m.get("quantization", ""), "freshness": found.freshness}


def status(spark: SparkSession, root: str) -> dict:
    """statistics() with the advice to compact, the snapshot's age and what does not serve."""
    s = statistics(spark, root)
    index, found = store.load(spark, root)
    ratio = s["stale_vectors"] / max(s["live_chunks"], 1)
    return s | {"stale_ratio": ratio, "advice": "compact" if ratio > ADVISE else None, "snapshot_age_minutes": store.snapshot_age_minutes(spark, root), "problems": index.problems, "freshness": found.freshness}


def audit(chunks: DataFrame, postings: DataFrame | None, vectors: DataFrame | None, claimed: int | None = None) -> DataFrame:
    """One row of an index's sums: chunks, orphan and missing postings, orphan and missing vectors, duplicate vectors, repeated
    chunk ids, statistics drift (live less claimed), and whether it is clean. An arm that is None is unscannable, its sums null."""
    ids = chunks.select("id").distinct()
    base = chunks.agg(F.count("*").alias("chunks"), (F.count("*") - F.countDistinct("chunk_id")).alias("repeated_ids"))

    def arm(df: DataFrame | None, name: str) -> DataFrame:
        spark = chunks.sparkSession
        if df is None:
            return spark.range(1).select(F.lit(None).cast("long").alias(f"orphan_{name}"), F.lit(None).cast("long").alias(f"missing_{name}"), F.lit(True).alias(f"{name}_unscannable"))
        j = df.select("id").distinct().withColumn("there", F.lit(1)).join(ids.withColumn("valid", F.lit(1)), "id", "full")
        return j.agg(F.count_if(F.col("valid").isNull()).alias(f"orphan_{name}"), F.count_if(F.col("there").isNull()).alias(f"missing_{name}"), F.lit(False).alias(f"{name}_unscannable"))

    twice = chunks.sparkSession.range(1).select(F.lit(None).cast("long").alias("duplicate_vectors")) if vectors is None else vectors.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_vectors"))
    out = base.crossJoin(F.broadcast(arm(postings, "postings"))).crossJoin(F.broadcast(arm(vectors, "vectors"))).crossJoin(F.broadcast(twice))  # one row each
    out = out.withColumn("stats_drift", F.lit(0).cast("long") if claimed is None else F.col("chunks") - claimed)
    bad = [F.coalesce(F.col(c), F.lit(0)) != 0 for c in ("orphan_postings", "missing_postings", "orphan_vectors", "missing_vectors", "duplicate_vectors", "repeated_ids", "stats_drift")]
    some = bad[0]
    for b in bad[1:]:
        some = some | b
    return out.withColumn("state", F.when(F.col("postings_unscannable") | F.col("vectors_unscannable"), "unscannable").when(some, "inconsistent").otherwise("clean"))


def integrity_summary(audits: DataFrame) -> DataFrame:
    """One row over many projects' audits: how many are clean, inconsistent and unscannable, and the sums of their counts."""
    total = lambda c: F.coalesce(F.sum(F.abs(F.col(c))), F.lit(0)).alias(c)
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return audits.agg(state("clean"), state("inconsistent"), state("unscannable"), *[total(c) for c in ("chunks", "orphan_postings", "missing_postings", "orphan_vectors", "missing_vectors", "duplicate_vectors", "repeated_ids", "stats_drift")])


def repaired(index: Index) -> Index:
    """The index without what its audit counts against it: orphan rows go, of a chunk's vectors one stays, and chunks that an arm
    misses leave that arm alone."""
    ids = index.chunks.select("id").distinct()
    one = lambda df: None if df is None else df.join(ids, "id", "left_semi")
    vectors = one(index.vectors)
    return Index(index.chunks.dropDuplicates(["chunk_id"]), one(index.postings), index.stats, None if vectors is None else vectors.groupBy("id").agg(F.min("v").alias("v")), index.analyser, list(index.problems))


def repaired_positions(n_vectors: int, metadata: DataFrame) -> DataFrame:
    """(position, chunk_id) for positions 0 to n_vectors - 1 from metadata (chunk_id, index_id): of several chunks at a position the
    first id; a position that none has is an error, as a partial map would give wrong answers."""
    at = metadata.where("index_id is not null").groupBy(F.col("index_id").cast("long").alias("position")).agg(F.min("chunk_id").alias("chunk_id"))
    j = metadata.sparkSession.range(n_vectors).withColumnRenamed("id", "position").join(at, "position", "left")
    return j.select("position", F.when(F.col("chunk_id").isNull(), F.raise_error(F.concat(F.lit("no chunk at position "), F.col("position")))).otherwise(F.col("chunk_id")).alias("chunk_id"))


def best_positions(found: DataFrame) -> DataFrame:
    """Of a query's several positions with one chunk the best-scoring: found (query_id, position, id, score)."""
    from rankloom.operators import fusion

    return fusion.best_per(found, ["query_id", "id"], F.desc("score"), "position")


def stop_indexing(spark: SparkSession, tag: str) -> list[str]:
    """Ends the jobs that run under a tag (spark.addTag); the index stays as it was."""
    return list(spark.interruptTag(tag))


def progress(spark: SparkSession, group: str) -> dict:
    """How far the jobs of a group (sparkContext.setJobGroup) are: jobs, running jobs, tasks and finished tasks of their stages."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
    stages = [s for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s]
    return {"jobs": len(jobs), "running": sum(j.status == "RUNNING" for j in jobs), "tasks": sum(s.numTasks for s in stages), "done": sum(s.numCompletedTasks for s in stages)}
