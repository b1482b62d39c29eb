"""Uploaded captures as files: what a gate needs to know comes from the file listing, never from the content.

Tasks write and list the files themselves. Spark's partitioned writer opens, marks and commits every file through several calls (on a local
disk processes) of its own, and its file index brings every listed file to the driver; both are kept for paths that only Spark can open.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}
KEYS = ("scan_id", "frame_index", "kind")
#: What Spark calls the folder of a null, and the characters that it writes as their code in folder names.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r'[\x01-\x1f"#%\'*/:=?\\\x7f{\[\]^]')


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path if "://" in local else os.path.abspath(local))


def _opens(path: str) -> bool:
    try:
        _open(path)
    except (pa.ArrowException, OSError, ValueError):  # a scheme of Hadoop's alone, or a library that is missing here
        return False
    return True


def _folder(key: str, value: object) -> str:
    said = "" if value is None else str(value)
    return f"{key}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', said) if said else NO_VALUE}"


def write_captures(captures: DataFrame, path: str) -> None:
    """``captures`` (scan_id, frame_index, kind, value) as files ``scan_id=…/frame_index=…/kind=…/…``, a line for each value; rows of one key share a file.

    A file gets its name when it is whole, the same name in every attempt of a task.
    """
    rows = captures.select(*KEYS, "value").repartition("scan_id")
    if not _opens(path):
        rows.write.partitionBy(*KEYS).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _open(path)
        now, out, n, hidden = None, None, 0, f".{uuid.uuid4().hex}"

        def close() -> None:
            if out is not None:
                out.close()
                where.move(f"{now}/{hidden}", f"{now}/capture.txt")

        for batch in batches:
            for scan, frame, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = "/".join([root, *map(_folder, KEYS, (scan, frame, kind))])
                if folder != now:
                    close()
                    where.create_dir(folder)
                    now, out, n = folder, where.open_output_stream(f"{folder}/{hidden}"), n + 1
                out.write((value or "").encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["files"])

    rows.sortWithinPartitions(*KEYS).mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


def _list(path: str, below: str, deep: bool) -> Iterator[pafs.FileInfo]:
    where, root = _open(path)
    at = f"{root.rstrip('/')}/{below}" if below else root
    for info in where.get_file_info(pafs.FileSelector(at)):
        # What Spark's own listing leaves out: hidden and unfinished files.
        if info.base_name.startswith(".") or info.base_name.startswith("_") and "=" not in info.base_name or info.base_name.endswith("._COPYING_"):
            continue
        if deep and info.type == pafs.FileType.Directory:
            yield from _list(path, info.path[len(root.rstrip("/")) + 1 :], deep)
        else:
            yield info


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with their keys as text: one task reads the scans' folders, many read what lies in them."""
    where, root = _open(path)
    if where.get_file_info(root).type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = f"file:{root}" if where.type_name == "local" else path
    names = ["name", "length", "modified"]
    kind = "name string, length bigint, modified timestamp"

    def batch(infos: list[pafs.FileInfo]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([i.path[len(root.rstrip("/")) + 1 :] for i in infos], pa.string()),
            pa.array([i.size if i.is_file else None for i in infos], pa.int64()),
            pa.array([i.mtime for i in infos], pa.timestamp("us", "UTC"))], names=names)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            infos = list(_list(path, "", False))
            for at in range(0, len(infos), 10_000):
                yield batch(infos[at : at + 10_000])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            files = some.filter(pc.is_valid(some.column("length")))
            yield files
            for folder in some.filter(pc.is_null(some.column("length"))).column("name").to_pylist():
                yield batch(list(_list(path, folder, True)))

    first = spark.range(1, numPartitions=1).mapInArrow(top, kind)
    files = first.repartition(8 * spark.sparkContext.defaultParallelism).mapInArrow(below, kind).where("length > 0")
    values = [F.nullif(F.nullif(F.try_url_decode(F.replace(F.regexp_extract("name", f"(?:^|/){k}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))), F.lit("")), F.lit(NO_VALUE)).alias(k) for k in KEYS]
    return files.select(*values, "length", F.col("modified").alias("modificationTime"), F.concat(F.lit(base.rstrip("/") + "/"), "name").alias("path"))


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path`` (``scan_id=…/frame_index=…/kind=…/…``): scan_id, frame_index, content_type, length, modified, file.

    An unknown kind has no content type. Length and time are the file system's. Empty files are not listed, as Spark lists none: an empty capture is a
    missing one here, and so counts against its scan's number of files; a table of captures with their lengths tells it apart.
    """
    types = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    files = _listing(spark, path) if _opens(path) else spark.read.format("binaryFile").option("basePath", path).load(path)
    return files.select(
        F.col("scan_id").cast("long").alias("scan_id"), F.col("frame_index").cast("int").alias("frame_index"), F.try_element_at(types, F.lower(F.col("kind").cast("string"))).alias("content_type"),
        "length", F.col("modificationTime").alias("modified"), F.col("path").alias("file"))
