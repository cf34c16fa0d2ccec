"""A table of keyed rows as a log of versions over Parquet files.

Each version is a manifest, a small JSON file that lists the folders of rows that make up the table, oldest first.
A commit writes its rows into a new folder and then renames a finished manifest to the next number, which
fails if another writer has taken it: a version is there whole or not at all, and two writers can't both make it.
Readers take a version; writers later than it don't touch its files. Rows carry the number of the version that wrote
them, and of a key's rows the last one counts; a deletion is such a row. ``compact`` replaces the log by the rows it stands for.
Keys aren't null. A folder holds one row of a key.

Manifests name folders only (one a commit), so the driver holds little; rows are read, joined and reduced by Spark.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has made the version in between."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        log = self._path("log")
        fs = log.getFileSystem(self.conf)
        if not fs.exists(log):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(log) if x.getPath().getName()[0] not in "._")

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/log/{version:020d}.json", wholetext=True).first()[0])

    def _commit(self, after: int, manifest: dict) -> int:
        temporary, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{after + 1:020d}.json")
        fs = temporary.getFileSystem(self.conf)
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        no_replacing = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf).rename(temporary, final, no_replacing)
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {after + 1} is there already") from None
            raise
        return after + 1

    def _write(self, rows: DataFrame, gone: bool, base: int | None, replace: bool = False) -> int:
        """A version after ``base`` (the last one if it isn't given) with these rows."""
        now = self.versions()
        after = base if base is not None else now[-1] if now else 0
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumns({"_version": F.lit(after + 1).cast("bigint"), "_gone": F.lit(gone)}).write.parquet(f"{self.folder}/{folder}")
        old = {"folders": [], "schema": rows.schema.json()} if replace or not after else self.manifest(after)
        return self._commit(after, {"folders": [*old["folders"], folder], "schema": old["schema"]})

    def put(self, rows: DataFrame, base: int | None = None, order: str | None = None) -> int:
        """Adds rows and replaces those of the same key. Of several rows of a key the last by ``order`` counts, which
        isn't stored (any one without an order)."""
        kept = [c for c in rows.columns if c != order]
        last = F.max_by(F.struct(*kept), F.col(order) if order else F.lit(0))
        return self._write(rows.groupBy(self.key).agg(last.alias("_row")).select("_row.*"), False, base)

    def change(self, changes: DataFrame, owner: str, columns: list[str], base: int | None = None, order: str | None = None) -> int:
        """New values of some columns where key and owner both agree with the table; changes of others do nothing."""
        at = self._base(base)
        last = F.max_by(F.struct(*columns), F.col(order) if order else F.struct(*columns))
        new = changes.groupBy(self.key, owner).agg(last.alias("_new"))
        old = self.read(at)
        rows = old.join(new, [self.key, owner])
        return self._write(rows.select(*(F.col(f"_new.{c}").alias(c) if c in columns else F.col(c) for c in old.columns)), False, at)

    def delete(self, keys: DataFrame, owner: str | None = None, base: int | None = None) -> int:
        """Without the rows that ``keys`` names, by key and, if it is given, owner."""
        at = self._base(base)
        on = [self.key, owner] if owner else [self.key]
        return self._write(self.read(at).join(keys.select(*on).distinct(), on, "left_semi"), True, at)

    def _base(self, base: int | None) -> int:
        now = self.versions()
        if base is None and not now:
            raise ValueError("the table has no version yet")
        return base if base is not None else now[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if it isn't given."""
        at = self._base(version)
        first, *later = (f"{self.folder}/{x}" for x in self.manifest(at)["folders"])
        base = self.spark.read.parquet(first)
        names = [c for c in base.columns if c not in ("_version", "_gone")]
        if not later:
            return base.filter(~F.col("_gone")).select(*names)
        # rows of the first folder that nothing has touched pass without being grouped
        rows = self.spark.read.parquet(*later)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*names, "_gone"), "_version").alias("_row"))
        changed = last.filter(~F.col("_row._gone")).select(*(F.col(f"_row.{c}").alias(c) for c in names))
        return base.filter(~F.col("_gone")).join(rows.select(self.key).distinct(), self.key, "left_anti").select(*names).unionByName(changed)

    def compact(self, base: int | None = None) -> int:
        """A version of the same rows in one folder."""
        at = self._base(base)
        return self._write(self.read(at), False, at, replace=True)
