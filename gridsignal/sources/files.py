"""A sink for whole files, and copies of files by pattern.

A row (name, content) becomes one file below the target folder. Tasks write to a folder of their own below
``_temporary``; only when all have ended are their files moved to their places, so a failed task or job leaves no half-written
file, and a task that ran twice counts once. Paths are any that Arrow's file systems open (local and shared folders, hdfs://,
s3://, gs://); reading is Spark's ``binaryFile``.
"""

from __future__ import annotations

import gzip
import posixpath
import re
import string
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "gridsignal_files"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path) or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder and the names inside it."""

    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, top = opened(self.path)
        own = posixpath.join(top, "_temporary", self.job, uuid.uuid4().hex)
        names: list[str] = []
        for row in iterator:
            name = posixpath.normpath(row["name"])
            if name.startswith(("..", "/")) or name == ".":
                raise ValueError(f"{row['name']!r} isn't a name below the target folder")
            target = posixpath.join(own, name)
            store.create_dir(posixpath.dirname(target), recursive=True)
            # the content is the file's: nothing is packed by the name's ending
            with store.open_output_stream(target, compression=None) as out:
                out.write(bytes(row["content"]))
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        twice = {n for n in names if names.count(n) > 1} if len(names) != len(set(names)) else set()
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows have the name of one file: {', '.join(sorted(twice)[:5])}")
        taken = [] if self.overwrite else [i.path for i in store.get_file_info([posixpath.join(top, n) for n in names]) if i.type != fs.FileType.NotFound]
        if taken:
            self.abort(messages)
            raise FileExistsError(taken[0])
        for m in done:
            for name in m.names:
                target = posixpath.join(top, name)
                store.create_dir(posixpath.dirname(target), recursive=True)
                store.move(posixpath.join(m.folder, name), target)
        self._clean(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, store: fs.FileSystem, top: str) -> None:
        """Remove this job's folder, and the folder of all jobs if no other has files in it."""
        jobs = posixpath.join(top, "_temporary")
        if store.get_file_info(posixpath.join(jobs, self.job)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(jobs, self.job))
        if store.get_file_info(jobs).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(jobs)):
            store.delete_dir(jobs)


class FileSink(DataSource):
    """``df.write.format("gridsignal_files").mode("append").save(folder)`` of rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite or self.options.get("replace") == "true")


def write_files(files: DataFrame, folder: str, replace: bool = True) -> None:
    """One file a row of (name, content), below ``folder``; names are told apart before anything is moved to its place."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format(FORMAT).option("replace", str(replace).lower()).mode("append").save(folder)


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, content) of the files below a folder, or of one file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def gzipped(files: DataFrame) -> DataFrame:
    """Files (name, content) packed by gzip, ``.gz`` behind their names; the same bytes each time."""
    return _mapped(files, lambda b: gzip.compress(b, mtime=0), F.concat(F.col("name"), F.lit(".gz")))


def gunzipped(files: DataFrame) -> DataFrame:
    """Files unpacked, without ``.gz``; other files stay as they are."""
    return _mapped(files, lambda b: gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b, F.regexp_replace("name", r"\.gz$", ""))


def _mapped(files: DataFrame, change: Callable[[bytes], bytes], name: Column) -> DataFrame:
    @F.udf("binary")
    def changed(content: bytes | None) -> bytes | None:
        return None if content is None else change(bytes(content))

    return files.withColumn("content", changed("content")).withColumn("name", name)


class MissingTagError(ValueError):
    """A target names a group that the pattern lacks."""


class DuplicateTargetError(ValueError):
    """Several files would be copied to one place."""


def copy_plan(names: DataFrame, pattern: str, basename: str, folders: list[str], replacements: list[tuple[str, str]] | None = None) -> DataFrame:
    """(name, target) of the names that begin with a match of ``pattern``; targets are format strings of its named groups.

    Names that don't match are left out. A target that several names share raises. ``name``: relative to the source folder.
    """
    tags = list(re.compile(pattern).groupindex)
    template = "/".join([*folders, basename])
    used = [field for _, field, _, _ in string.Formatter().parse(template) if field is not None]
    missing = sorted(set(used) - set(tags))
    if missing:
        raise MissingTagError(f"groups that {pattern!r} lacks: {', '.join(missing)}")
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    at = re.compile(pattern).groupindex
    parts: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.regexp_extract("name", f"^(?:{java})", at[field])] if field is not None else []
    target = F.concat(*parts)
    for old, new in replacements or []:
        target = F.replace(target, F.lit(old), F.lit(new))
    plan = names.filter(F.col("name").rlike(f"^(?:{java})")).select("name", target.alias("target"))
    shared = plan.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).filter("n > 1").limit(5).collect()
    if shared:
        raise DuplicateTargetError("; ".join(f"{r['a']}, {r['b']} -> {r['target']}" for r in shared))
    return plan


def copy_matching(spark: SparkSession, source: str, pattern: str, basename: str, folders: list[str], target: str, dry: bool = False, replacements: list[tuple[str, str]] | None = None, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Copy the files below ``source`` whose relative paths match; returns the plan (name, target), which ``dry`` only makes.

    ``change`` gets the plan and returns the rows that are to be copied, targets changed or rows left out as it likes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    top = re.sub(r"^file:/*", "/", source.rstrip("/")) + "/"
    relative = F.substring_index("path", top, -1)
    plan = copy_plan(files.select(relative.alias("name")), pattern, basename, folders, replacements)
    plan = change(plan) if change else plan
    if not dry:
        write_files(files.select(relative.alias("_from"), "content").join(plan, F.col("_from") == F.col("name")).select(F.col("target").alias("name"), "content"), target)
    return plan
