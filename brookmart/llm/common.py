"""What the corpus operators share: tables, scratch tables on shared storage, hashed folds, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch in the operators that run Python: long documents stay within a worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Folders of sessions without spark.checkpoint.dir, by application: the setting can't be changed in a running session.
_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where none is set, a local folder serves sessions that run
    in one process; a cluster's session must set one, since executors don't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="brookmart-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: a query's shuffle files go when the query ends, not when the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to shared storage and reads them again."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the path, for tables that discard() takes away again. The write's shuffle files go at once."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of ids up to which small() sends them to every task: some 20 MB.
SENT_IDS = 300_000


def small(ids: DataFrame) -> DataFrame:
    """Ids, to be joined by broadcast if counting them shows that they are few; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids


def placed(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """rows, which have a column `tree`, with `row`, a number of their own, `place`, from 0 in their tree by `order`, and `size`,
    the number of rows in the tree; also the paths of scratch tables, to be discarded when the result has been written. No
    tree meets in one task: a range sort deals the rows out, and those that lie before a partition are counted by partition."""
    named = rows.withColumn("row", F.monotonically_increasing_id())  # written, so that it stays what it is
    first, one = stored(named, "leaves")
    by = ["tree", *order, "row"]
    dealt = first.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt, two = stored(dealt, "sorted")
    part = F.shiftright("at", 33)
    counts = dealt.groupBy("tree", part.alias("part")).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    # one row for each partition and tree in it, so never more than partitions and trees together
    sums = counts.selectExpr("tree", "part", "least", "sum(n) over (partition by tree order by part) - n as before", "sum(n) over (partition by tree) as size")
    sums = sums.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), "least", "before", "size")
    on = F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part"))
    out = dealt.join(small(sums), on).withColumn("place", F.col("at") - F.col("least") + F.col("before"))
    return out.drop("_tree", "_part", "least", "before", "at"), [one, two]


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [next(t for k in range(len(taken) + 1) if (t := n + "_" * k).lower() not in taken) for n in names]


def fold(column: str, n: int) -> Column:
    """crc32 of the id's text mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: str = "text") -> Column:
    """Whole text as bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, payload, label) of at most `limit` labelled rows, those with the smallest hash of the id.

    The bound is the documented size of the training sample; ids are drawn before any text is read,
    so that only `limit` texts are shuffled. Of an id that repeats, the smallest text counts.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(keep)
        .groupBy(key).agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64(key), key).limit(limit)
    )
    rows = docs.select(key, utf8().alias("payload")).join(F.broadcast(ids), key)  # at most `limit` ids
    return rows.groupBy(key).agg(F.min("payload").alias("payload"), F.max("label").alias("label"))


def map_rows(df: DataFrame, key: str, columns: dict[str, Column], run: Callable, fields: str) -> DataFrame:
    """(key, fields) from mapInPandas over (key, columns) in small batches. The key travels as text, so that nulls and
    large numbers come back as they were; other columns of df aren't read."""
    small_batches(df.sparkSession)
    sent = df.select(F.col(key).cast("string").alias(key), *(c.alias(n) for n, c in columns.items()))
    out = sent.mapInPandas(run, f"`{key}` string, {fields}")
    return out.withColumn(key, F.col(key).cast(dict(df.dtypes)[key]))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of at least that many rows, but for the last."""
    kept, n = [], 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)
