"""Small driver files on any file system that Spark reaches: read, replaced whole, listed, deleted."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None where there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place, flushed to disk, and moved there."""
    fs, p = _at(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs.mkdirs(p.getParent())
    stream = fs.create(side, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(side, p):
        raise OSError(f"{path} cannot be written")


def read_json(spark: SparkSession, path: str) -> Any:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """old takes the place of new, if there is one."""
    fs, p = _at(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(to):
        fs.delete(to, True)
    if not fs.rename(p, to):
        raise OSError(f"{old} cannot be moved to {new}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.delete(p, True))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none where there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
