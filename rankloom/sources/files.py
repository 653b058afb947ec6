"""File sources: a directory tree as rows, ignore rules, strict UTF-8, and what may not be a project's root."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import chunking

# Names of directories and files that are never read, and suffixes of such files.
IGNORED_NAMES = [
    "__pycache__", ".git", ".hg", ".svn",
    ".venv", "venv", "env", ".env", ".direnv",
    "node_modules", ".pnpm-store", ".yarn",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".pytype", ".ipynb_checkpoints",
    "build", "dist", "out", "public",
    ".next", ".nuxt", ".svelte-kit", ".angular", ".astro", ".vite",
    ".cache", ".parcel-cache", ".turbo",
    "coverage", ".coverage", ".nyc_output",
    ".gradle", ".idea", ".vscode", ".docusaurus", ".vercel", ".serverless", ".terraform", ".mvn", ".tox",
    "target", "bin", "obj", ".DS_Store", "Thumbs.db",
]
IGNORED_SUFFIXES = [".pyc", ".pyo"]
#: Names that a bulk scan leaves out besides.
BULK_IGNORED = ["logs"]
# Directories of credentials, and of the system, that are no projects.
SENSITIVE_NAMES = [".ssh", ".gnupg", ".gpg", ".aws", ".azure", ".config", ".docker", ".kube", ".helm", ".vault", ".credentials", ".password-store"]
SYSTEM_PREFIXES = ["/etc", "/var", "/root", "/proc", "/sys", "/boot", "/dev"]


def ignored(path: Column, more: list[str] | None = None) -> Column:
    """Whether any part of a relative path is ignored: by its name, or by its end."""
    parts = F.split(path, "/")
    names = F.array(*[F.lit(x) for x in [*IGNORED_NAMES, *(more or [])]])
    ends = F.exists(parts, lambda p: F.lit(False) if not IGNORED_SUFFIXES else p.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in IGNORED_SUFFIXES) + r")\z"))
    return F.arrays_overlap(parts, names) | ends


def escaping_links(root: str) -> list[str]:
    """Relative paths of a local tree's symbolic links that lead out of it; none for trees of other file systems."""
    base = root.removeprefix("file://")
    if "://" in base or not os.path.isdir(base):
        return []
    real, out = os.path.realpath(base), []
    for folder, dirs, names in os.walk(base):  # links themselves, not what they lead to
        for n in [*dirs, *names]:
            p = os.path.join(folder, n)
            if os.path.islink(p) and not (os.path.realpath(p) + "/").startswith(real + "/"):
                out.append(os.path.relpath(p, base))
        dirs[:] = [d for d in dirs if d not in IGNORED_NAMES]
    return sorted(out)


def walk(spark: SparkSession, root: str, more_ignored: list[str] | None = None) -> DataFrame:
    """(path, size, modified, content) of the files below root, paths relative to it; ignored parts and escaping links left out.

    The files are listed and read by Spark; a folder that cannot be read gives no rows. Content is read only where it is used.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    scheme = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    base = "/" + root.split("://", 1)[-1].strip("/") if "://" in root else os.path.abspath(root)
    rel = F.expr("url_decode(replace(p, '+', '%2B'))")
    rows = raw.withColumn("p", F.regexp_replace(scheme, "^/+", "/")).withColumn("p", F.substring(rel, len(base.rstrip("/")) + 2, 1 << 20))
    out = rows.select(F.col("p").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").where(~ignored(F.col("path"), more_ignored))
    for link in escaping_links(root):
        out = out.where(~((F.col("path") == link) | F.col("path").startswith(link + "/")))
    return out


def supported(files: DataFrame) -> DataFrame:
    """Files whose suffix a chunker knows."""
    return files.where(chunking.language(F.col("path")).isNotNull())


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content) with text, and error where the content is not valid UTF-8 (then text is null, and no chunk comes of it)."""
    t = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("text", t).withColumn("error", F.when(F.col("content").isNull(), "unreadable").when(t.isNull(), "not_utf8")).drop("content")


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash, size) of files (path, content): sha256 of the bytes, of Markdown without its front matter; an unreadable file's
    is that of its path."""
    head = F.lower("path").rlike(r"\.(md|mdx|markdown)$") & F.col("content").cast("string").startswith("---")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    close = F.locate("\n---", text, 4)
    body = F.when(head & (close > 0), F.encode(F.substring(text, close + 4, F.char_length(text)), "UTF-8")).otherwise(F.col("content"))
    return files.select("path", F.sha2(F.coalesce(body, F.encode("path", "UTF-8")), 256).alias("hash"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"))


def chunk_tree(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """Chunks of all supported files below root (or of these suffixes), as a bulk scan reads them."""
    files = supported(walk(spark, root, BULK_IGNORED))
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    return chunking.chunk_files(decoded(files).select("path", "text"))


def refused_root(path: str, allowed: list[str] | None = None, home: str | None = None, sensitive: bool = True) -> str | None:
    """Why a folder may not be a project's root, or None: empty, the home folder, a file system's root, outside the allowed roots,
    below a folder of credentials or of the system, or with more than 5 repositories among its first 50 entries."""
    if not path:
        return "empty path"
    p = Path(path).resolve()
    own = Path(home).resolve() if home else Path.home().resolve()
    if p == own:
        return f"{p} is the home folder"
    if p.parent == p:
        return f"{p} is a file system root"
    under = lambda a, b: a == b or b in a.parents
    if allowed and not any(under(p, Path(a).resolve()) for a in allowed):
        return f"{p} is not below an allowed root"
    if sensitive:
        bad = next((x for x in p.parts if x in SENSITIVE_NAMES), None) or next((x for x in SYSTEM_PREFIXES if under(p, Path(x)) and not under(own, Path(x))), None)
        if bad:
            return f"{p} is below {bad}"
    try:
        first = sorted(p.iterdir())[:50] if p.is_dir() else []
    except OSError:
        first = []
    if sum(x.is_dir() and (x / ".git").exists() for x in first) > 5:
        return f"{p} holds more than 5 repositories"
    return None
