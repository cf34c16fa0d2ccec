"""Files and tables as sources and sinks. Tables go through Spark's own readers and writers. Folders of files are listed,
read and written by tasks: Spark's reader of files would hold all their names in the driver."""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import codecs
from tessel.operators.graph import written
from tessel.shared import shipped
from tessel.sources.objects import batched, moved, opened, put_file, tasks_of

#: Media types by extension.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "ico": "image/x-icon", "wav": "audio/wav", "mp3": "audio/mpeg"}


def matcher(pattern: str) -> re.Pattern:
    """Hadoop's patterns of names: *, ?, [abc], [^abc] and {one,other}."""
    if found := re.search(r"\{([^{}]*)\}", pattern):
        names = [pattern[: found.start()] + x + pattern[found.end() :] for x in found[1].split(",")]
        return re.compile("|".join(matcher(n).pattern for n in names))
    return re.compile(fnmatch.translate(pattern.replace("[^", "[!")))


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether it is a folder) of what lies in a folder; names that begin with _ or . are hidden."""
    if isinstance(fs, pafs.LocalFileSystem):  # one after the other, however many
        with os.scandir(folder) as found:
            for x in found:
                if x.name[0] not in "._":
                    yield x.path, 0 if x.is_dir() else x.stat().st_size, x.is_dir()
    else:
        for x in fs.get_file_info(pafs.FileSelector(folder)):
            if x.base_name[:1] not in "._":
                yield x.path, x.size or 0, x.type == pafs.FileType.Directory


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below a folder, level by level: a folder's entries are read by a task, and names stay in tables."""
    fs, root = opened(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, bool]] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_()))], ["path", "length", "folder"])
        for b in batches:
            for at in b.column(0).to_pylist():
                for x in entries(fs, at):
                    out.append(x)
                    if len(out) == 10_000:
                        yield told()
                        out.clear()
        if out:
            yield told()

    level, found = shipped(spark).createDataFrame([(root,)], "path string").coalesce(1), []
    while True:
        found.append(written(level.mapInArrow(run, "path string, length bigint, folder boolean"), "listing"))
        folders = found[-1].filter("folder").select("path")
        n = folders.count() if recursive else 0
        if not n:
            return reduce(DataFrame.unionByName, found).filter("not folder").select("path", "length")
        level = folders.repartition(tasks_of(n))


def readable(folder: str) -> bool:
    """Whether tasks can list it themselves: one folder, of a file system that is known here."""
    try:
        fs, root = opened(folder)
        return not re.search(r"[*?\[\]{}]", folder) and fs.get_file_info(root).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError, ValueError):
        return False


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, content, media) of each file. What only Spark can open, and patterns of folders, its reader lists."""
    pairs = [F.lit(x) for kv in MEDIA.items() for x in kv]
    media = F.try_element_at(F.create_map(*pairs), F.lower(F.substring_index("path", ".", -1))).alias("media")
    if not readable(folder):
        df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
        return df.select("path", "length", "content", media)
    fs, root = opened(folder)
    # paths are told as Spark tells them
    start = "file:" + root if isinstance(fs, pafs.LocalFileSystem) else folder.rstrip("/")
    wanted = matcher(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (path for b in batches for path in b.column(0).to_pylist() if wanted.match(path.rsplit("/", 1)[-1]))
        for some in batched(fs, paths):
            names, contents = zip(*some)
            columns = [pa.array([start + n[len(root) :] for n in names]), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", "content"])

    found = listed(spark, folder, recursive)
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    dealt = found.select("path").repartition(max(tasks_of(n), -(-size // (128 << 20))))
    return dealt.mapInArrow(run, "path string, length bigint, content binary").select("path", "length", "content", media)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files with ids and the sizes that their headers name. Each file is read once."""
    found = files(spark, folder).filter(F.col("media").startswith("image/"))
    return codecs.dimensions(found, found.columns).withColumn("id", F.xxhash64("path"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(route): the folders below ``folder`` that hold an index page, by their path from there."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "index.html").option("recursiveFileLookup", True).load(folder).select("path")
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    route = F.regexp_extract("path", f"/\\Q{base}\\E/(.+)/index\\.html$", 1)
    return found.select(route.alias("route")).filter("route <> ''").distinct()


def wav_seconds(content):
    """Duration of a WAV file: the data chunk's length, wherever it begins in the first 4 kB, over
    the bytes per second; 0 if the file is of another kind or names none."""
    h = F.hex(F.substring(content, 1, 4096))
    little = lambda at: F.conv(F.concat(*(F.substring(h, at + 2 * i, F.lit(2)) for i in (3, 2, 1, 0))), 16, 10).cast("bigint")
    form, data = F.instr(h, "666D7420"), F.instr(h, "64617461")
    rate = F.when(h.startswith("52494646") & (form > 0) & (data > 0), little(form + 32))
    return F.coalesce(F.when(rate > 0, little(data + 8) / rate), F.lit(0.0))


def put(objects: DataFrame, folder: str) -> DataFrame:
    """Writes each of ``objects`` (key string, content binary) as a file under its key and returns
    (key, length); what is written is written by the tasks when the result is used. A file appears
    under its name when it is complete, so a task that runs again replaces it with the same. Keys
    with an empty or a parent part are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        own = f"{root}/_temporary/{uuid.uuid4().hex}"  # readers skip this folder
        fs.create_dir(own, recursive=True)
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                if any(part in ("", ".", "..") for part in key.split("/")):
                    raise ValueError(f"no key: {key}")
                put_file(fs, f"{own}/part", content.as_py())
                moved(fs, f"{own}/part", f"{root}/{key}")
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64())], ["key", "length"])
        fs.delete_dir(own)

    return objects.select("key", "content").mapInArrow(run, "key string, length bigint")


def append(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Adds rows to a Parquet table, in partitions of columns that queries filter by."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def append_valid(df: DataFrame, folder: str, quarantine: str) -> None:
    """Rows that ``checked`` found valid go to the table, the others to the quarantine."""
    append(df.filter("valid").drop("valid", "failed"), folder)
    append(df.filter("not valid"), quarantine)


def write_text(df: DataFrame, folder: str) -> None:
    """One line for each row of (value)."""
    df.select("value").write.mode("overwrite").text(folder)
