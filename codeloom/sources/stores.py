"""Folders in any store that pyarrow reads: file, hdfs, s3, gs.

Spark's own file sources leave out empty files and names that start with a dot
or an underscore, all of which count in a source tree. So folders are listed and
files read by tasks, a level of the tree at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

BATCH_BYTES = 16 << 20


def file_system(uri: str):
    """(pyarrow file system, path) of a folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def walk(spark: SparkSession, root: str, skipped: list[str]) -> DataFrame:
    """(path) of the files below root, relative to it, without folders that are skipped or start with a dot.

    A job for each level of the tree; the folders of a level are dealt over the tasks. What can't
    be listed is left out.
    """

    def below(batches):
        from pyarrow import fs as pfs

        fs, top = file_system(root)
        for b in batches:
            out: list[tuple[str, bool]] = []
            for folder in b.column(0).to_pylist():
                try:
                    found = fs.get_file_info(pfs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/") or "/"))
                except OSError:
                    continue
                for x in found:
                    name, is_folder = x.base_name, x.type == pfs.FileType.Directory
                    if not (is_folder and (name in skipped or name.startswith("."))):
                        out.append((f"{folder}/{name}" if folder else name, is_folder))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_())], ["path", "is_folder"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = cut(level.mapInArrow(below, "path string, is_folder boolean"))
        new = found.where("NOT is_folder").select("path")
        files = new if files is None else files.unionAll(new)
        level = found.where("is_folder").select("path").repartition(F.col("path"))
        if level.isEmpty():
            return files


def read(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of paths(path); files that are gone are left out."""

    def contents(batches):
        fs, top = file_system(root)
        for b in batches:
            names: list[str] = []
            texts: list[bytes] = []
            size = 0
            for p in b.column(0).to_pylist():
                try:
                    with fs.open_input_stream(f"{top.rstrip('/')}/{p}", compression=None) as f:
                        texts.append(f.read())
                    names.append(p)
                    size += len(texts[-1])
                except OSError:
                    continue
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
                    names, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(contents, "path string, content binary")
