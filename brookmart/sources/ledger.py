"""Each batch once in a database table: rows go to a staging table in parallel, then one transaction moves them to the target
and notes (query, batch) in a ledger. A batch that is in the ledger is left alone, one that isn't is staged anew, so it
doesn't matter where the attempt before stopped."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "staged_row"


@contextmanager
def connection(spark: SparkSession, url: str, options: dict[str, str]) -> Iterator:
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    settings = jvm.java.util.Properties()
    for k in options.keys() & {"user", "password"}:
        settings.setProperty(k, options[k])
    c = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        yield c
    finally:
        c.close()


def _run(c, sql: str) -> None:
    statement = c.createStatement()
    try:
        statement.execute(sql)
    finally:
        statement.close()


def _exists(c, table: str) -> bool:
    found = c.getMetaData().getTables(None, None, "%", None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == table.lower():
            return True
    return False


def _noted(c, ledger: str, query: str, batch: int) -> bool:
    ask = c.prepareStatement(f"SELECT 1 FROM {ledger} WHERE query_name = ? AND batch_id = ?")
    ask.setString(1, query)
    ask.setLong(2, batch)
    found = ask.executeQuery().next()
    ask.close()
    return found


def write_once(df: DataFrame, url: str, table: str, query: str, batch: int, columns: list[str] | None = None, **options: str) -> bool:
    """Adds the rows of a query's batch to the table, unless the ledger has them (False). Staged rows are numbered and the
    number is unique, so a task that is done again after it had committed fails instead of doubling its rows, and the
    batch starts anew. The tables are made where they are missing; rows pass from executors to the database."""
    spark, ledger = df.sparkSession, f"{table}_ledger"
    stage = f"{table}_stage_{abs(hash_of(query))}"
    rows = df.select(*(columns or df.columns))
    jdbc = lambda frame, name: frame.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()
    with connection(spark, url, options) as c:
        if not _exists(c, ledger):
            _run(c, f"CREATE TABLE {ledger} (query_name VARCHAR(200) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (query_name, batch_id))")
        if _noted(c, ledger, query, batch):
            return False
        if _exists(c, stage):
            _run(c, f"DROP TABLE {stage}")
        if not _exists(c, table):
            jdbc(rows.limit(0), table)
        numbered = rows.withColumn(ROW, F.monotonically_increasing_id())
        jdbc(numbered.limit(0), stage)
        _run(c, f'CREATE UNIQUE INDEX {stage}_row ON {stage} ("{ROW}")')
    jdbc(numbered, stage)
    names = ", ".join(f'"{n}"' for n in rows.columns)
    with connection(spark, url, options) as c:
        c.setAutoCommit(False)
        try:
            _run(c, f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")
            note = c.prepareStatement(f"INSERT INTO {ledger} VALUES (?, ?)")
            note.setString(1, query)
            note.setLong(2, batch)
            note.executeUpdate()
            note.close()
            c.commit()
        except BaseException:
            c.rollback()
            raise
        c.setAutoCommit(True)
        _run(c, f"DROP TABLE {stage}")
    return True


def hash_of(text: str) -> int:
    """A number for a name that may hold characters that tables can't have; the same in every process."""
    return zlib.crc32(text.encode())


def writer(url: str, table: str, query: str, dims: Callable[[DataFrame], DataFrame] = lambda b: b, **options: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch once, with dimension columns looked up when it is written."""
    return lambda batch, n: write_once(dims(batch), url, table, query, n, **options) and None
