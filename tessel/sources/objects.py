"""A Spark data source of files as objects: ``spark.read.format("objects")`` and ``df.write.format("objects")``.

Reading: rows (key, length, content), in partitions of about ``bytesPerPartition`` bytes, so many small files
share a task. Writing: rows (key, content). A task writes into a folder of its own below ``_temporary``, which
readers skip, and tells the driver what it wrote; the driver moves the files of those tasks that it
commits to their keys. A task that fails leaves no file under a key, and of a task that ran twice one result is taken.
Tasks that still write when the job ends can't: the job's folder is the driver's, and they make none above their own.
Mode append adds and replaces objects, overwrite removes those that were there first.

The source's own listing and the sink's moves are the driver's, file by file. ``load`` and ``save`` are for any number of objects:
tasks list, and tasks move what the driver has committed.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessel.shared import new_folder, shipped

# Spark plans reads and commits writes in a Python of its own beside the driver, which doesn't know this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEMPORARY = "_temporary"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, (os.path.abspath(root) if isinstance(fs, pafs.LocalFileSystem) else root).rstrip("/")


def tasks_of(names: int) -> int:
    """Tasks for so many small files: some thousands each."""
    return max(1, min(-(-names // 2000), max(96, -(-names // 16_384))))


def put_file(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """A new file; on a local disk the plain call takes a fraction of the time of the other."""
    with open(path, "wb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_output_stream(path) as out:
        out.write(content)


def moved(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Gives a file its name; the folder is made only if it isn't there."""
    try:
        fs.move(source, target)
    except OSError:
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        fs.move(source, target)


def batched(fs: pafs.FileSystem, paths: Iterator[str], most: int = 1 << 20) -> Iterator[list[tuple[str, bytes]]]:
    """(path, content) of files, a few thousand or about ``most`` bytes at once."""
    held, size = [], 0
    for path in paths:
        with fs.open_input_stream(path) as f:
            held.append((path, f.read()))
        size += len(held[-1][1])
        if size >= most or len(held) == 4000:
            yield held
            held, size = [], 0
    if held:
        yield held


def objects_in(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """All files below the folder but those of unfinished writes, by path."""
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda path: any(part[:1] in "._" for part in path.removeprefix(f"{root}/").split("/"))
    return sorted((x for x in found if x.type == pafs.FileType.File and not hidden(x.path)), key=lambda x: x.path)


def checked(key: str | None) -> str:
    parts = (key or "").split("/")
    if any(not part or part[0] in "._" for part in parts):
        raise ValueError(f"no key: {key}")
    return key


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Part(InputPartition):
    """A file of a table of paths."""

    at: str


class Reader(DataSourceReader):
    def __init__(self, path: str, most: int, listing: str | None = None):
        self.path, self.most, self.listing = path, most, listing

    def partitions(self) -> list[Files | Part]:
        """Files in order, a new partition when the last would be too large. Of a listing each part is one."""
        if self.listing:
            return [Part(x.path) for x in objects_in(*opened(self.listing))] or [Files([])]
        out, size = [], 0
        for x in objects_in(*opened(self.path)):
            if not out or size + x.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [Files([])]

    def read(self, partition: Files | Part) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        for some in batched(fs, iter(partition.paths) if isinstance(partition, Files) else listed_in(opened(self.listing)[0], partition.at)):
            paths, contents = zip(*some)
            keys = pa.array([p.removeprefix(f"{root}/") for p in paths])
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], ["key", "length", "content"])


def listed_in(fs: pafs.FileSystem, at: str) -> Iterator[str]:
    with fs.open_input_file(at) as f:
        for b in pq.ParquetFile(f).iter_batches(columns=["path"]):
            yield from b.column(0).to_pylist()


def without(fs: pafs.FileSystem, folder: str, tries: int = 20) -> None:
    """Deletes the folder; again, where a task that still writes has put a file beside those that were being deleted."""
    for left in reversed(range(tries)):
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return
        try:
            fs.delete_dir(folder)
        except OSError:
            if not left:
                raise


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: files 0, 1, ... of its folder, and their keys, or in a job that is published later how many
    there are; then the folder holds a table of the keys."""

    folder: str
    keys: list[str]
    n: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, job: str | None = None):
        self.path, self.overwrite, self.begun, self.later = path, overwrite, False, bool(job)
        self.job = job or uuid.uuid4().hex

    def begin(self) -> Writer:
        """Makes the job's folder, without which no task writes from here on."""
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/{TEMPORARY}/{self.job}", recursive=True)
        self.begun = True
        return self

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        folder, keys = f"{root}/{TEMPORARY}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=not self.begun)
        for b in batches:
            names = b.schema.names
            for key, content in zip(b.column(names.index("key")).to_pylist(), b.column(names.index("content"))):
                keys.append(checked(key))
                put_file(fs, f"{folder}/{len(keys) - 1}", content.as_py() or b"")
        if not self.later:
            return Written(folder, keys, len(keys))
        with fs.open_output_stream(f"{folder}/keys") as out:
            pq.write_table(pa.table({"path": pa.array(keys, pa.string())}), out)
        return Written(folder, [], len(keys))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        if self.later:
            done = {"overwrite": self.overwrite, "tasks": [(m.folder, m.n) for m in messages if m]}
            with fs.open_output_stream(f"{root}/{TEMPORARY}/{self.job}/done") as out:
                out.write(json.dumps(done).encode())
            return
        if self.overwrite:
            for x in objects_in(fs, root):
                fs.delete_file(x.path)
        for m in messages:
            for key, i in {key: i for i, key in enumerate(m.keys if m else [])}.items():
                moved(fs, f"{m.folder}/{i}", f"{root}/{key}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for folder in (f"{root}/{TEMPORARY}/{self.job}", f"{root}/{TEMPORARY}"):
            selector = pafs.FileSelector(folder, allow_not_found=True)
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(selector)):
                without(fs, folder)


class Objects(DataSource):
    """Options: path; of a reader bytesPerPartition (128 MB if it isn't given), or listing, a folder of tables of paths, a partition each;
    of a writer job, the name of a job that ``save`` publishes."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, length bigint, content binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytesPerPartition", 128 << 20)), self.options.get("listing"))

    def writer(self, schema, overwrite: bool) -> Writer:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if kinds.get("key") != "string" or kinds.get("content") != "binary":
            raise ValueError("objects have a key (string) and a content (binary)")
        return Writer(self.options["path"], overwrite, self.options.get("job")).begin()


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format known to it and its workers."""
    shipped(spark).dataSource.register(Objects)
    return spark


def load(spark: SparkSession, folder: str, most: int = 128 << 20) -> DataFrame:
    """The objects of a folder of any number of them: tasks list it, in parts of about ``most`` bytes, and the source reads these."""
    from tessel.sources.files import listed

    found, listing = listed(registered(spark), folder), new_folder(spark, "paths")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found.select("path").repartition(max(tasks_of(n), -(-size // most))).write.parquet(listing)
    return spark.read.format("objects").option("listing", listing).load(folder)


def save(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes any number of objects: as the sink does, but the driver commits a list of tasks, and other tasks give the files their
    names once that is done. Of a key that is there more than once the last one in the order of tasks stays."""
    spark, job = registered(df.sparkSession), uuid.uuid4().hex
    df.write.format("objects").option("job", job).mode(mode).save(folder)
    fs, root = opened(folder)
    with fs.open_input_stream(f"{root}/{TEMPORARY}/{job}/done") as f:
        done = json.loads(f.read())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, at in zip(*(c.to_pylist() for c in b.columns)):
                own = list(listed_in(fs, at))
                columns = [own, [place] * len(own), range(len(own)), [at.removesuffix("/keys")] * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["key", "task", "i", "folder"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, source in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    moved(fs, source, f"{root}/{key}")
                except OSError:  # a try before this one has done it
                    if fs.get_file_info([source, f"{root}/{key}"])[0].type != pafs.FileType.NotFound:
                        raise
            yield b.slice(0, 0)

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                if fs.get_file_info(path).type == pafs.FileType.File:
                    fs.delete_file(path)
            yield b.slice(0, 0)

    if done["overwrite"]:
        from tessel.sources.files import listed

        listed(spark, folder).select("path").mapInArrow(gone, "path string").count()
    n = tasks_of(sum(n for _, n in done["tasks"]))
    tasks = spark.createDataFrame([(i, f"{at}/keys") for i, (at, _) in enumerate(done["tasks"])], "task bigint, at string").repartition(n)
    last = tasks.mapInArrow(keys, "key string, task bigint, i bigint, folder string").repartition(n, "key").groupBy("key").agg(F.max(F.struct("task", "i", "folder")).alias("_"))
    last.select("key", F.concat_ws("/", "_.folder", "_.i").alias("source")).mapInArrow(named, "key string, source string").count()
    Writer(folder, False, job).abort([])
