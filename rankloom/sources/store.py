"""Index storage: generations published by a manifest, with a prior one to fall back on; snapshots; the project registry.

A project's folder holds gen=<id>/{chunks,postings,stats,vectors}, manifest/{current,prior}.json, snapshot/snapshot_id=<id>,
snapshot_info/<id>.json and project_info.json. A generation is written whole and checked before the manifest names it, so a failed
or cancelled build leaves what was there. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import lexical
from rankloom.operators.search import Index
from rankloom.sources import fs

MANIFEST_VERSION = 1
PARTS = ("chunks", "postings", "stats", "vectors")
CHUNKS = "id long, chunk_id string, path string, kind string, name string, parent string, docstring string, start_line int, end_line int, text string, tags array<string>, content_preview string, folder_structure array<string>, language string, file_hash string"
VECTORS = "id long, v array<float>"
POSTINGS = "term string, id long, col int, at array<int>, d int"
STATS = "rows_n long, avg_d double"
_SCHEMAS = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "stats": STATS}


class InconsistentManifest(ValueError):
    """Artifacts that are missing or disagree in their number of records."""


class TruncatedIndex(ValueError):
    """A new index that lost more than half of the old one's chunks."""


@dataclass(frozen=True)
class Loaded:
    """manifest: None if there is none to use; freshness: fresh, stale_using_prior_epoch, missing or corrupt."""

    manifest: dict | None
    freshness: str
    detail: str = ""


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


def checksum(spark: SparkSession, path: str) -> tuple[str, int]:
    """sha256 over the sorted names and sha256 of a folder's part files, and their bytes. Files are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), "length").collect()  # one row a part file
    text = "\n".join(f"{r.name} {r.sha}" for r in sorted(rows, key=lambda r: r.name))
    return hashlib.sha256(text.encode()).hexdigest(), sum(r.length for r in rows)


def build_manifest(spark: SparkSession, root: str, artifacts: Mapping[str, tuple[str, int | None]], **facts) -> dict:
    """A manifest of artifacts: name to (folder relative to root, number of records or None). The numbers must agree.

    facts: provider, model, vector_dim, quantization, pipeline_version, input_type_enabled.
    """
    out, counts = {}, {}
    for name, (rel, count) in artifacts.items():
        if not fs.exists(spark, f"{root}/{rel}"):
            raise InconsistentManifest(f"{name} is missing: {rel}")
        sha, size = checksum(spark, f"{root}/{rel}")
        out[name] = {"path": rel, "sha256": sha, "bytes": size, "count": count}
        if count is not None:
            counts[name] = count
    if len(set(counts.values())) > 1:
        raise InconsistentManifest(f"numbers of records differ: {counts}")
    base = {"provider": "", "model": "", "vector_dim": 0, "quantization": "float32", "pipeline_version": "", "input_type_enabled": False}
    share = {"all_artifacts_share_count": True, "expected_count": next(iter(counts.values()))} if counts else {}
    return base | facts | {"version": MANIFEST_VERSION, "epoch_id": uuid.uuid4().hex, "created_at": now(), "artifacts": out, "consistency": share}


def verify_manifest(spark: SparkSession, root: str, manifest: dict) -> str | None:
    """What is wrong with the artifacts that a manifest names, or None."""
    for name, a in sorted(manifest.get("artifacts", {}).items()):
        if not fs.exists(spark, f"{root}/{a['path']}"):
            return f"{name} is missing"
        if checksum(spark, f"{root}/{a['path']}") != (a["sha256"], a["bytes"]):
            return f"{name} has changed"
    return None


def _manifest(spark: SparkSession, root: str, which: str) -> tuple[dict | None, str]:
    try:
        m = fs.read_json(spark, f"{root}/manifest/{which}.json")
    except (ValueError, OSError) as e:
        return None, f"{which}.json cannot be read: {type(e).__name__}"
    return (m, "") if isinstance(m, dict) and "artifacts" in m else (None, f"{which}.json is missing" if m is None else f"{which}.json is no manifest")


def commit_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """candidate is written first; current becomes prior only while it is sound; then candidate becomes current."""
    folder = f"{root}/manifest"
    fs.write_json(spark, f"{folder}/candidate.json", manifest)
    held, _ = _manifest(spark, root, "current")
    if held is not None and verify_manifest(spark, root, held) is None:
        fs.rename(spark, f"{folder}/current.json", f"{folder}/prior.json")
    fs.rename(spark, f"{folder}/candidate.json", f"{folder}/current.json")


def read_manifest(spark: SparkSession, root: str) -> Loaded:
    """The current manifest if its artifacts are sound, else the prior one, else why there is none; never a half-written one."""
    wrong = []
    for which, freshness in (("current", "fresh"), ("prior", "stale_using_prior_epoch")):
        m, why = _manifest(spark, root, which)
        why = why if m is None else verify_manifest(spark, root, m) or ""
        if m is not None and not why:
            return Loaded(m, freshness, "; ".join(wrong))
        wrong.append(why if m is None else f"{which} failed: {why}")
    none = wrong == ["current.json is missing", "prior.json is missing"]
    return Loaded(None, "missing" if none else "corrupt", "; ".join(wrong))


def publish(spark: SparkSession, root: str, parts: Mapping[str, DataFrame], force: bool = False, **facts) -> dict:
    """Writes a generation of chunks, postings, stats and vectors and makes it current; the manifest.

    Refused, with what was there left as it is: chunks and vectors that differ in number (vectors of no rows: an index without
    them), repeated chunk ids, and, unless force, under half as many chunks as the current generation's 5 or more.
    """
    gen = f"gen={uuid.uuid4().hex}"
    try:
        for name in PARTS:
            df = parts[name]
            df = lexical.by_term(df) if name == "postings" else df  # row groups of few terms: a search reads its own
            df.write.parquet(f"{root}/{gen}/{name}")
        have = {n: spark.read.parquet(f"{root}/{gen}/{n}") for n in PARTS}
        n, ids = have["chunks"].agg(F.count("*"), F.countDistinct("id")).first()
        if n != ids:
            raise InconsistentManifest(f"{n - ids} chunks have another's id")
        old = read_manifest(spark, root).manifest
        was = old["artifacts"]["chunks"]["count"] if old else 0
        if not force and was >= 5 and n < 0.5 * was:
            raise TruncatedIndex(f"{n} chunks would take the place of {was}")
        vectors = have["vectors"].count()
        counts = {"chunks": n, "postings": None, "stats": None, "vectors": vectors or None}
        manifest = build_manifest(spark, root, {k: (f"{gen}/{k}", c) for k, c in counts.items()}, **facts)
        commit_manifest(spark, root, manifest)
    except Exception:
        fs.delete(spark, f"{root}/{gen}")
        raise
    prune(spark, root)
    return manifest


def prune(spark: SparkSession, root: str) -> list[str]:
    """Deletes generations that neither the current nor the prior manifest names; their folders."""
    used = {a["path"].split("/")[0] for which in ("current", "prior") for m in [_manifest(spark, root, which)[0]] if m for a in m["artifacts"].values()}
    gone = [n for n in fs.names(spark, root) if n.startswith("gen=") and n not in used]
    for n in gone:
        fs.delete(spark, f"{root}/{n}")
    return gone


def load(spark: SparkSession, root: str, analyser: str = "porter", verify: bool = True) -> tuple[Index, Loaded]:
    """The index that the manifest names, and how fresh it is. An arm whose artifact cannot be read is left out and listed in the
    index's problems; without a sound manifest chunks of the newest readable generation do not serve: the index is empty."""
    found = read_manifest(spark, root) if verify else Loaded(*((m, "fresh") if (m := _manifest(spark, root, "current")[0]) else (None, "missing")))
    if found.manifest is None:
        empty = lambda n: spark.createDataFrame([], _SCHEMAS[n])
        return Index(empty("chunks"), None, None, None, analyser, [found.detail]), found
    own, problems = {}, []
    for name in PARTS:
        try:
            own[name] = spark.read.parquet(f"{root}/{found.manifest['artifacts'][name]['path']}")
        except (PySparkException, KeyError) as e:
            own[name] = None
            problems.append(f"{name} cannot be read: {type(e).__name__}")
    if own["chunks"] is None:
        raise InconsistentManifest(problems[0])
    if not found.manifest["artifacts"]["vectors"].get("count"):
        own["vectors"] = None
    return Index(own["chunks"], own["postings"], own["stats"], own["vectors"], analyser, problems), found


def arms_that_serve(index: Index) -> Index:
    """The index without the arms whose files fail when they are read whole: a damaged part disables its arm alone."""
    for name in ("postings", "vectors"):
        df = getattr(index, name)
        try:
            if df is not None:
                df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  whatever a damaged file raises
            setattr(index, name, None)
            index.problems.append(f"{name} failed: {type(e).__name__}")
    return index


# ---- snapshots ----


def save_snapshot(spark: SparkSession, root: str, files: DataFrame, keep: int = 5, **facts) -> str:
    """files (path, hash, size) as the newest snapshot; at most keep of them stay. Its id."""
    sid = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:6]}"
    files.select("path", "hash", "size").write.parquet(f"{root}/snapshot/snapshot_id={sid}")
    n, size = spark.read.parquet(f"{root}/snapshot/snapshot_id={sid}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fs.write_json(spark, f"{root}/snapshot_info/{sid}.json", {"snapshot_id": sid, "last_snapshot": now(), "file_count": n, "total_size": size} | facts)
    for old in [x["snapshot_id"] for x in list_snapshots(spark, root)][keep:]:
        delete_snapshot(spark, root, old)
    return sid


def list_snapshots(spark: SparkSession, root: str) -> list[dict]:
    """What is known of each snapshot, newest first; unreadable entries are left out."""
    out = []
    for name in fs.names(spark, f"{root}/snapshot_info"):
        try:
            x = fs.read_json(spark, f"{root}/snapshot_info/{name}")
        except ValueError:
            continue
        if isinstance(x, dict) and "snapshot_id" in x:
            out.append(x)
    return sorted(out, key=lambda x: x["snapshot_id"], reverse=True)


def load_snapshot(spark: SparkSession, root: str, sid: str | None = None) -> DataFrame | None:
    """(path, hash, size) of a snapshot, else of the newest; None where there is none."""
    sid = sid or next((x["snapshot_id"] for x in list_snapshots(spark, root)), None)
    path = f"{root}/snapshot/snapshot_id={sid}"
    return spark.read.parquet(path) if sid and fs.exists(spark, path) else None


def delete_snapshot(spark: SparkSession, root: str, sid: str) -> None:
    fs.delete(spark, f"{root}/snapshot_info/{sid}.json")
    fs.delete(spark, f"{root}/snapshot/snapshot_id={sid}")


def snapshot_age_minutes(spark: SparkSession, root: str) -> float | None:
    x = next(iter(list_snapshots(spark, root)), None)
    return None if x is None else (dt.datetime.now(dt.UTC) - dt.datetime.fromisoformat(x["last_snapshot"])).total_seconds() / 60


# ---- projects ----


def project_id(path: str, provider: str = "") -> str:
    """md5 of the path, with :provider where there is one."""
    return hashlib.md5(f"{path}:{provider}".encode() if provider else path.encode()).hexdigest()


def project_folder(base: str, name: str, path: str, provider: str = "") -> str:
    """Where a project's index lies: its name and the first 8 digits of its id."""
    return f"{base}/projects/{name}_{project_id(path, provider)[:8]}"


_INFO = "project_name string, project_path string, project_hash string, created_at string, embedding_provider string, embedding_model string, embedding_dimension int, content_mode string, index_format_version int, pipeline_version string"
_COUNTS = "total_chunks long, live_chunks long, files_indexed long, embedding_dimension int, index_type string, quantization string"


def register(spark: SparkSession, root: str, name: str, path: str, provider: str = "", model: str = "", dim: int = 0, content_mode: str = "code", pipeline: str = "") -> dict:
    info = {"project_name": name, "project_path": path, "project_hash": project_id(path, provider), "created_at": now(), "embedding_provider": provider, "embedding_model": model, "embedding_dimension": dim, "content_mode": content_mode, "index_format_version": 1, "pipeline_version": pipeline}
    fs.write_json(spark, f"{root}/project_info.json", info)
    return info


def list_projects(spark: SparkSession, base: str) -> DataFrame:
    """One row a project below base/projects, with its statistics where it has some (a left join by folder)."""

    def read(name: str, fields: str) -> DataFrame:
        schema = T._parse_datatype_string(fields)
        try:
            raw = spark.read.text(f"{base}/projects/*/{name}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"/projects/([^/]+)/", 1).alias("folder"), F.from_json("value", schema).alias("x"))
            return raw.select("folder", "x.*")
        except PySparkException:  # no such file yet
            return spark.createDataFrame([], T.StructType([T.StructField("folder", T.StringType()), *schema.fields]))

    info, stats = read("project_info.json", _INFO), read("stats.json", _COUNTS).drop("embedding_dimension")
    return info.where("project_path is not null").join(stats, "folder", "left")


def find_project(spark: SparkSession, base: str, path: str, provider: str | None = None) -> str:
    """The folder of the project of this path; an error where there is none, or several providers' and none is named."""
    rows = list_projects(spark, base).where((F.col("project_path") == path) & (F.lit(True) if provider is None else F.col("embedding_provider") == provider)).select("folder", "embedding_provider").collect()
    if len(rows) != 1:
        raise LookupError(f"no project of {path}" if not rows else f"{path} is indexed by {sorted(r[1] for r in rows)}: name a provider")
    return f"{base}/projects/{rows[0][0]}"


def delete_project(spark: SparkSession, root: str) -> bool:
    return fs.delete(spark, root)


def clear_index(spark: SparkSession, root: str) -> None:
    """Generations, manifests and snapshots go; the project stays registered."""
    for n in fs.names(spark, root):
        if n.startswith("gen=") or n in ("manifest", "snapshot", "snapshot_info", "stats.json"):
            fs.delete(spark, f"{root}/{n}")
