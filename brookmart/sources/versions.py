"""Tables in versions: a new version rewrites only the parts that change, and readers see whole versions only.

    path/data/v=N/<part>=P/...   rows of part P as version N left them
    path/manifest/N.json         for each part of version N, the version that wrote it; also the schema

A manifest is put in place by a rename after all its files are there, so a crash half-way leaves the version before. What
the driver holds is a name per part: hash buckets, whose number is fixed, or days.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import upsert_dim


class Files:
    """The few calls that a store needs of the file system, whichever Spark reaches by the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        where = self.path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """A whole file or none: written aside, then renamed."""
        aside = self.path(f"{path}.tmp")
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(aside, self.path(path)):
            raise OSError(f"{path} is there already")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class Versions:
    """A table at `path` whose rows are kept by the values of column `part` (whole numbers or dates)."""

    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path_, self.part, self.files = spark, path.rstrip("/"), part, Files(spark, path)

    def published(self) -> list[int]:
        """Finished versions, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path_}/manifest") if n.endswith(".json"))

    def newest(self, before: int | None = None) -> int | None:
        found = [v for v in self.published() if before is None or v < before]
        return found[-1] if found else None

    def manifest(self, version: int) -> dict:
        """{"parts": {part: version that wrote it}, "schema": the table's schema}"""
        return json.loads(self.files.read(f"{self.path_}/manifest/{version}.json"))

    def read(self, version: int | None = None, parts: Iterable | None = None) -> DataFrame | None:
        """The table as of a version, the newest by default; with `parts` only those are listed and read. None if there is no
        version. The part is a partition column, so filters on it prune folders."""
        version = self.newest() if version is None else version
        if version is None:
            return None
        found = self.manifest(version)
        schema = T.StructType.fromJson(found["schema"])
        wanted = None if parts is None else {str(p) for p in parts}
        folders = [f"{self.path_}/data/v={v}/{self.part}={p}" for p, v in sorted(found["parts"].items()) if wanted is None or p in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path_}/data").parquet(*folders).select(schema.names)

    def publish(self, version: int, rows: DataFrame, touched: Iterable, files_per_part: int = 1, merge: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None) -> None:
        """Makes a version from the one before: `rows` are all rows of the `touched` parts, other parts stay as they are. A touched
        part without rows is gone. Files of an attempt that failed are overwritten. `merge` groups the rows by the part, what
        deals it out and `keys`, after they have been dealt out, so that one exchange serves both."""
        base = self.newest(version)
        old = self.manifest(base)["parts"] if base is not None else {}
        touched = {str(p) for p in touched}
        data = f"{self.path_}/data/v={version}"
        deal = [self.part]
        if files_per_part > 1:
            rows, deal = rows.withColumn("_file", F.pmod(F.xxhash64(*(keys or rows.columns)), F.lit(files_per_part))), [self.part, "_file"]
        dealt = rows.repartition(max(1, min(len(touched) * files_per_part, 1000)), *deal)
        rows = (merge(dealt) if merge else dealt).drop("_file")
        rows.write.mode("overwrite").partitionBy(self.part).parquet(data)
        there = {n.split("=", 1)[1] for n in self.files.names(data) if n.startswith(f"{self.part}=")}
        parts = {p: v for p, v in old.items() if p not in touched} | {p: version for p in there}
        self.files.put(f"{self.path_}/manifest/{version}.json", json.dumps({"parts": parts, "schema": rows.schema.jsonValue()}))

    def vacuum(self, keep: int) -> None:
        """Removes all but the newest `keep` versions, and the files that none of these names. A reader has as long as it takes
        to publish `keep` versions. Only the writer may call this."""
        versions = self.published()
        kept = versions[-keep:]
        for v in versions[:-keep]:
            self.files.delete(f"{self.path_}/manifest/{v}.json")
        named = {(v, p) for k in kept for p, v in self.manifest(k)["parts"].items()}
        for name in self.files.names(f"{self.path_}/data"):
            v = int(name.removeprefix("v="))
            if not kept or v > kept[-1]:
                continue  # being written
            parts = [n for n in self.files.names(f"{self.path_}/data/{name}") if n.startswith(f"{self.part}=")]
            gone = [p for p in parts if (v, p.split("=", 1)[1]) not in named]
            for p in gone if len(gone) < len(parts) else ():
                self.files.delete(f"{self.path_}/data/{name}/{p}")
            if len(gone) == len(parts):
                self.files.delete(f"{self.path_}/data/{name}")


class DimStore(Versions):
    """A dimension in hash buckets of its key: an upsert reads and writes only the buckets of changed keys."""

    def __init__(self, spark: SparkSession, path: str, pk: str = "id", buckets: int = 64):
        super().__init__(spark, path, "bucket")
        self.pk, self.buckets = pk, buckets

    def bucket(self) -> Column:
        """By the key's text, so that a key of another type but the same text meets its row."""
        return F.pmod(F.xxhash64(F.col(self.pk).cast("string")), F.lit(self.buckets)).cast("int")

    def dim(self, version: int | None = None, keys: Iterable[str] | None = None) -> DataFrame | None:
        """The dimension as of a version; with `keys` only their buckets are read."""
        parts = None
        if keys is not None:
            asked = self.spark.createDataFrame([(str(k),) for k in keys], f"`{self.pk}` string")
            parts = [r[0] for r in asked.select(self.bucket()).distinct().collect()]
        found = self.read(version, parts)
        return found if found is None else found.drop("bucket")

    def upsert(self, changes: DataFrame, version: int, seq: Column | str = "seq", columns: list[str] | None = None, null_overwrites: bool = False, keep: int | None = 3) -> bool:
        """Publishes the state after these changes as `version`. A version that is there already stays as it is (False), so a
        batch that is done again changes nothing. Rows without a key can't be stored."""
        if version in self.published():
            return False
        rows = changes.where(F.col(self.pk).isNotNull()).persist()
        try:
            touched = [r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]  # at most `buckets`
            base = self.newest(version)
            old = None if base is None else self.read(base, touched).drop("bucket")
            self.publish(version, upsert_dim(old, rows, self.pk, seq, columns, null_overwrites).withColumn("bucket", self.bucket()), touched)
        finally:
            rows.unpersist()
        if keep:
            self.vacuum(keep)
        return True


class Rollup(Versions):
    """Statistics by day of the window's start, merged as they come: `merge` names for each measure how two states of it
    become one (sum, min or max). Only the days of the incoming windows are read and written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: dict[str, str]):
        super().__init__(spark, path, "dt")
        self.keys, self.merge = keys, merge

    def merged(self, rows: DataFrame, *more: str) -> DataFrame:
        types = dict(rows.dtypes)
        how: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max}
        return rows.groupBy(*more, *self.keys).agg(*(how[h](c).cast(types[c]).alias(c) for c, h in self.merge.items()))

    def add(self, rows: DataFrame, version: int, keep: int | None = 3, files_per_day: int = 1) -> bool:
        """Merges rows (keys, among them stt, and measures) into the days they belong to; once for each version."""
        if version in self.published():
            return False
        rows = rows.select(*self.keys, *self.merge).persist()
        try:
            day = F.to_date("stt")
            days = [r[0] for r in rows.select(day.alias("dt")).distinct().collect()]
            base = self.newest(version)
            full = rows if base is None else rows.unionByName(self.read(base, days).select(*rows.columns))
            merge = lambda dealt: self.merged(dealt, *(c for c in ("_file", "dt") if c in dealt.columns)).select(*rows.columns, "dt")
            self.publish(version, full.withColumn("dt", day), days, files_per_day, merge, self.keys)
        finally:
            rows.unpersist()
        if keep:
            self.vacuum(keep)
        return True
