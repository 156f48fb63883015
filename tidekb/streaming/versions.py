"""A table of batches under versioned manifests (S3).

``path/_versions`` holds one small file per version that lists the folders of ``path`` which make up the table and the
batches that they contain. A version is published by creating its file, which succeeds for one writer only; a writer that
comes second starts again from the version that won. Readers take the newest complete version and read its folders, so
they see a compaction or a batch as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

KEEP = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _load(spark: SparkSession, path: str, number: int) -> dict | None:
    """A version, or null while its file is being written."""
    fs, p = _fs(spark, f"{path}/_versions/{number:012d}")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest complete version: its number, and ``folders`` {name: batch numbers in it}, ``retired`` folders."""
    for n in reversed(_numbers(spark, path)):
        got = _load(spark, path, n)
        if got is not None:
            return n, got
    return 0, {"folders": {}, "retired": {}}


def _publish(spark: SparkSession, path: str, number: int, version: dict) -> bool:
    fs, p = _fs(spark, f"{path}/_versions/{number:012d}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    return True


def add_batch(rows: DataFrame, path: str, batch_id: int) -> bool:
    """Write a batch and publish it; a batch that some version already contains, compacted or not, changes nothing."""
    spark = rows.sparkSession
    _, now = current(spark, path)
    if any(batch_id in ids for ids in now["folders"].values()):
        return False
    folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    while True:
        number, now = current(spark, path)
        if any(batch_id in ids for ids in now["folders"].values()):
            return False
        if _publish(spark, path, number + 1, {"folders": now["folders"] | {folder: [batch_id]}, "retired": now["retired"]}):
            return True


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or of a given one; null if it has none."""
    version = current(spark, path)[1] if number is None else _load(spark, path, number)
    names = sorted(version["folders"])
    return spark.read.parquet(*[f"{path}/{n}" for n in names]) if names else None


def compact(spark: SparkSession, path: str, fold) -> int:
    """Write ``fold(rows)`` of the newest version as one folder and publish it in place of the folders that it came from.

    Batches that arrive meanwhile stay beside it. Folders retired ``KEEP`` versions ago are deleted, so readers that began
    before the swap can finish. Returns the new version's number.
    """
    number, before = current(spark, path)
    if not before["folders"]:
        return number
    folder = f"folded-{uuid.uuid4().hex}"
    fold(read_version(spark, path, number)).write.parquet(f"{path}/{folder}")
    while True:
        number, now = current(spark, path)
        if not before["folders"].keys() <= now["folders"].keys():
            raise RuntimeError("another compaction replaced the folders meanwhile; its result stands")
        rest = {n: ids for n, ids in now["folders"].items() if n not in before["folders"]}
        ids = sorted(i for n in before["folders"] for i in before["folders"][n])
        old = {n: v for n, v in now["retired"].items() if number + 1 - v <= KEEP}
        version = {"folders": rest | {folder: ids}, "retired": old | {n: number + 1 for n in before["folders"]}}
        if _publish(spark, path, number + 1, version):
            for n in now["retired"].keys() - old.keys():
                fs, p = _fs(spark, f"{path}/{n}")
                fs.delete(p, True)
            return number + 1
