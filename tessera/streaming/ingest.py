"""Consume each landing file once (Structured Streaming file source + checkpoint), and clean up exactly
the files that were accepted, once their batch is committed."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.paths import relative_to
from tessera.sources.files import CSV_OPTIONS


def ingest_new_files(spark: SparkSession, source: str, schema: T.StructType | str, fmt: str = "csv",
                     max_files: int | None = None, **options) -> DataFrame:
    """A streaming DataFrame over files not yet consumed under ``source`` (a folder or a glob such as
    ``root/*/*/LOAD*.csv``), with the file path of every row in ``file``.

    A file stream needs a declared schema. Nothing is moved or removed here; see :func:`consume_once`.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.options(**CSV_OPTIONS)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    r = r.options(**{k: str(v) for k, v in options.items()})
    return r.load(source).withColumn("file", F.col("_metadata.file_path"))


@dataclass(frozen=True)
class AcceptedFile:
    """A landing file as it was listed when its batch took it."""

    path: str
    size: int
    modified: int


class Files:
    """The few file-system calls of the clean-up (any store that Spark knows), made by the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def stat(self, path: str) -> AcceptedFile | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        s = fs.getFileStatus(p)
        return AcceptedFile(path, s.getLen(), s.getModificationTime())

    def escaped(self, path: str) -> str:
        """The path as a URI."""
        return self._at(path)[1].toUri().toString()

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, spark: SparkSession, path: str) -> str:
        return spark.read.text(path, wholetext=True).first()[0]

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, target: str) -> bool:
        fs, p = self._at(path)
        _, t = self._at(target)
        fs.mkdirs(t.getParent())
        return not fs.exists(t) and fs.rename(p, t)


def new_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """A stream of the files below ``root``, at any depth, that were not there before: one row (path, size, modified) each.

    Contents are not read. Names that begin with ``_`` or ``.`` are left out, as by every file source.
    """
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(root).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def consume_once(spark: SparkSession, root: str, accepts: str, checkpoint: str, write_batch: Callable[[list[str], str], None],
                 archive_dir: str | None = None, delete: bool = False, max_files: int | None = None) -> StreamingQuery:
    """Hand the new files that the rule accepts to ``write_batch(paths, batch name)``, batch by batch, until none is left.

    ``accepts`` is a pattern for the path below ``root``, anchored at its start only. A batch lists at most ``max_files`` files (of
    any kind); its accepted ones are noted beside the checkpoint, with the size and time they were listed with, before it is
    written. ``write_batch`` must be safe to repeat under the same name, which no other batch or checkpoint has.

    When the run has ended, and so its batches are committed, exactly the noted files are removed (``delete``) or moved
    below ``archive_dir``. A file that the rule does not accept, or that was replaced since it was listed, is never touched. A
    run that died before its clean-up is cleaned up after by the next one.
    """
    files, notes = Files(spark), f"{checkpoint.rstrip('/')}-accepted"
    key = relative_to(F.col("path"), root)

    def step(listed: DataFrame, batch_id: int) -> None:
        # the driver holds the names of one batch's files
        found = [AcceptedFile(*r) for r in listed.filter(key.rlike(f"\\A(?:{accepts})")).collect()]
        run = json.loads(files.read(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        name = f"{run}-{batch_id:09d}"
        files.write(f"{notes}/{name}.json", json.dumps([asdict(f) for f in found]))
        if found:
            write_batch([f.path for f in found], name)

    q = new_files(spark, root, max_files).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if archive_dir or delete:
        for name in files.names(notes):
            if name.endswith(".json"):
                clean_up(spark, (AcceptedFile(**f) for f in json.loads(files.read(spark, f"{notes}/{name}"))), root, archive_dir)
                files.move(f"{notes}/{name}", f"{notes}/cleaned/{name}")
    return q


def plain(path: str) -> str:
    """A path as a reader's argument: characters that a glob would take as its own are escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def key_below(path: str, root: str) -> str:
    """A file's path below the root, with or without a scheme on either."""
    bare, base = (re.sub("^file:(//)?", "", p) for p in (path, root.rstrip("/") + "/"))
    return bare[len(base):] if bare.startswith(base) else path


def clean_up(spark: SparkSession, accepted: Iterable[AcceptedFile], root: str, archive_dir: str | None = None) -> None:
    """Remove (or move below ``archive_dir``, under the same key) the files that are still what was accepted."""
    files = Files(spark)
    for own in accepted:
        if files.stat(own.path) == own:
            if archive_dir:
                files.move(own.path, f"{archive_dir.rstrip('/')}/{key_below(own.path, root)}")
            else:
                files.delete(own.path)


def run_available_now(df: DataFrame, path: str, checkpoint: str, fmt: str = "csv", partition_by=None,
                      options: dict | None = None, timeout_s: float | None = None) -> StreamingQuery:
    """Append the stream to ``path`` (exactly once through the checkpoint) until all files that were
    present at start are consumed, then stop."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS).option("ignoreLeadingWhiteSpace", "false") \
             .option("ignoreTrailingWhiteSpace", "false")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w = w.options(**(options or {}))
    q = w.trigger(availableNow=True).start(path)
    q.awaitTermination(timeout_s)
    return q
