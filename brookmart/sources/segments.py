"""Topics kept as segments: records with partition, offset and time, read by ranges of offsets in batches and streams.

    path/data/batch=N/partition=P/*.parquet   records of one write
    path/manifest/N.json                      its files, each with its range of offsets, and the ends of all partitions

A write is there when its manifest is, so readers see whole writes, and a write that is done again changes nothing. The
offsets of a partition have no gaps; a stream's position is the next offset of each partition and lives in its
checkpoint. Executors read the files with Arrow, on a local or shared file system or one that Arrow knows by its URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .versions import Files

SCHEMA = "partition int, offset bigint, timestamp timestamp, value string"
#: A file: partition, first offset, number of records, path below the topic.
File = tuple[int, int, int, str]


def write_segments(df: DataFrame, path: str, batch_id: int, key: Column | str, partitions: int = 8, timestamp: str = "timestamp", value: str = "value", most: int = 1_000_000) -> bool:
    """Appends (timestamp, value) records; rows of one key share a partition and keep the order of their times. False if the
    batch is there already. Batches must come one after the other. Files hold at most `most` records."""
    spark, path = df.sparkSession, path.rstrip("/")
    files = Files(spark, path)
    there = sorted(int(n.removesuffix(".json")) for n in files.names(f"{path}/manifest") if n.endswith(".json"))
    if batch_id in there:
        return False
    ends = {int(p): e for p, e in json.loads(files.read(f"{path}/manifest/{there[-1]}.json"))["ends"].items()} if there else {}
    start = F.coalesce(F.create_map(*(F.lit(x) for kv in ends.items() for x in kv))[F.col("partition")], F.lit(0)) if ends else F.lit(0)
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    rows = df.select(part.alias("partition"), F.col(timestamp).cast("timestamp").alias("timestamp"), F.col(value).cast("string").alias("value"))
    place = F.row_number().over(Window.partitionBy("partition").orderBy("timestamp", "value")) - 1
    rows = rows.withColumn("offset", start.cast("long") + place).select("partition", "offset", "timestamp", "value")
    data = f"{path}/data/batch={batch_id}"
    rows.write.mode("overwrite").partitionBy("partition").option("maxRecordsPerFile", most).parquet(data)
    found = spark.read.parquet(data).groupBy(F.col("partition").cast("int").alias("p"), F.input_file_name().alias("file")).agg(F.min("offset").alias("first"), F.count(F.lit(1)).alias("n"))
    made = sorted((r.p, r.first, r.n, r.file[r.file.index("data/batch=") :]) for r in found.collect())  # one row for each file of this write
    for p, first, n, _ in made:
        ends[p] = max(ends.get(p, 0), first + n)
    files.put(f"{path}/manifest/{batch_id}.json", json.dumps({"ends": ends, "files": made}))
    return True


class Log:
    """What the manifests say."""

    def __init__(self, path: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///").replace("file://///", "file:///"))

    def _manifests(self) -> list[dict]:
        listed = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/manifest", allow_not_found=True))
        names = sorted((f.path for f in listed if f.base_name.endswith(".json")), key=lambda p: int(p.rsplit("/", 1)[1][:-5]))
        out = []
        for n in names:
            with self.fs.open_input_stream(n) as f:
                out.append(json.loads(f.read()))
        return out

    def files(self) -> list[File]:
        return [tuple(f) for m in self._manifests() for f in m["files"]]

    def ends(self) -> dict[str, int]:
        found = self._manifests()
        return found[-1]["ends"] if found else {}

    def read(self, file: File, low: int, high: int) -> Iterator:
        """Record batches of the offsets from low up to high, the latter left out."""
        table = pyarrow.parquet.read_table(f"{self.root}/{file[3]}", filesystem=self.fs, columns=["offset", "timestamp", "value"], partitioning=None)
        table = table.filter((pyarrow.compute.field("offset") >= low) & (pyarrow.compute.field("offset") < high))
        time = table["timestamp"].cast(pyarrow.timestamp("us", "UTC"))
        part = pyarrow.array([file[0]] * table.num_rows, pyarrow.int32())
        yield from pyarrow.table({"partition": part, "offset": table["offset"], "timestamp": time, "value": table["value"]}).to_batches()


class Range(InputPartition):
    def __init__(self, file: File, low: int, high: int):
        self.file, self.low, self.high = file, low, high


def ranges(log: Log, start: dict[str, int], end: dict[str, int]) -> list[Range]:
    out = []
    for file in log.files():
        p = str(file[0])
        low, high = max(file[1], start.get(p, 0)), min(file[1] + file[2], end.get(p, 0))
        if low < high:
            out.append(Range(file, low, high))
    return out


def first_offsets(log: Log, starting: str) -> dict[str, int]:
    """`starting`: earliest, latest, or a JSON object of offsets by partition; partitions that it doesn't name start at 0."""
    if starting == "earliest":
        return {}
    return log.ends() if starting == "latest" else {str(p): int(o) for p, o in json.loads(starting).items()}


class _Reads:
    def read(self, partition: Range) -> Iterator:
        return Log(self.path).read(partition.file, partition.low, partition.high)


class SegmentReader(_Reads, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.starting = options["path"], options.get("starting", "earliest")

    def partitions(self) -> list[Range]:
        log = Log(self.path)
        return ranges(log, first_offsets(log, self.starting), log.ends())


class SegmentStream(_Reads, DataSourceStreamReader):
    """A trigger takes the offsets from the last position to the ends, or `limit` of each partition at most. A query that goes on
    from its checkpoint first asks for the empty range at its position, which tells it; an available-now run is one trigger."""

    def __init__(self, options: dict[str, str]):
        self.path, self.starting = options["path"], options.get("starting", "latest")
        self.limit, self.at = int(options.get("limit", 0)), None

    def initialOffset(self) -> dict[str, int]:
        log = Log(self.path)
        return {p: 0 for p in log.ends()} | first_offsets(log, self.starting)

    def latestOffset(self) -> dict[str, int]:
        at = self.initialOffset() if self.at is None else self.at
        ends = Log(self.path).ends()
        if self.limit:
            ends = {p: min(e, at.get(p, 0) + self.limit) for p, e in ends.items()}
        self.at = at | {p: max(e, at.get(p, 0)) for p, e in ends.items()}
        return self.at

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        self.at = end
        return ranges(Log(self.path), start, end)


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SegmentStream(self.options)


def read_segments(spark: SparkSession, path: str, starting: str | dict[int, int] | None = None, stream: bool = False, limit: int = 0) -> DataFrame:
    """(partition, offset, timestamp, value) of a topic kept as segments, from `starting` on (earliest, latest, or offsets by
    partition). `limit` bounds the records that a trigger takes of each partition."""
    spark.dataSource.register(Segments)
    start = json.dumps({str(p): o for p, o in starting.items()}) if isinstance(starting, dict) else starting or ("latest" if stream else "earliest")
    if start == "latest" and not stream:
        raise ValueError("a batch has an end; it can't start at the latest record")
    return (spark.readStream if stream else spark.read).format("segments").options(path=path, starting=start, limit=limit).load()
