"""Change events of source tables: normalise, route by rules, project, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_deletes(df: DataFrame) -> DataFrame:
    return df.where(~F.col("type").eqNullSafe("delete"))


def normalise_change(df: DataFrame) -> DataFrame:
    """Raw change record (topic server.db.table, op) to an envelope; absent row images become empty maps."""
    parts = F.split("topic", r"\.")
    op = F.lower("op")
    kind = F.when(op.isin("c", "create"), "insert").when(op == "u", "update").when(op == "d", "delete").when(op == "r", "read").otherwise(op)
    empty = F.create_map().cast("map<string,string>")
    rest = [c for c in df.columns if c not in ("topic", "before", "after", "op")]
    return df.select(
        *rest, F.get(parts, 1).alias("database"), F.get(parts, 2).alias("tableName"),
        F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"), kind.alias("type"))


def load_rules(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Routing rules from the change events of the rule table: last write wins, deletes remove nothing."""
    names = ("sourceTable", "operateType", "sinkType", "sinkTable", "sinkColumns", "sinkPk", "sinkExtend")
    rows = drop_deletes(changes).select(seq, *(F.col("after")[n].alias(n) for n in names))
    last = rows.groupBy("sourceTable", "operateType").agg(F.max_by(F.struct(*names[2:]), seq).alias("r"))
    return last.select("sourceTable", "operateType", "r.*")


def route(df: DataFrame, rules: DataFrame) -> DataFrame:
    """All rows with the rule's columns and `route`: fact, dim, unmatched, or null for a rule of another sink. One join; the
    rule table has one row for a table and kind of change, and is joined as Spark sees fit by its size."""
    r = rules.select("sourceTable", "operateType", "sinkType", "sinkTable", "sinkColumns", F.coalesce("sinkPk", F.lit("id")).alias("sinkPk"))
    on = (F.col("tableName") == F.col("sourceTable")) & (F.col("type") == F.col("operateType"))
    kind = F.when(F.col("sourceTable").isNull(), "unmatched").when(F.col("sinkType") == "kafka", "fact").when(F.col("sinkType") == "hbase", "dim")
    return df.join(r, on, "left").withColumn("route", kind).drop("sourceTable", "operateType")


def route_changes(df: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, dims, unmatched) for jobs that treat them apart; those that don't take route()."""
    rows = route(df, rules)
    facts, dims = (rows.where(F.col("route") == k).drop("route") for k in ("fact", "dim"))
    return facts, dims, rows.where("route = 'unmatched'").select(df.columns)


def typed_changes(lines: DataFrame, columns: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(changes, rejects) of change envelopes as JSON text, with row images typed by `columns` (DDL). A row whose text isn't JSON
    or one of whose values doesn't fit its type goes aside whole, with the names of what didn't fit (`errors`). Columns that
    an image lacks are null, an absent image is null. All other columns of `lines` stay."""
    fields = T.StructType.fromDDL(columns).fields
    v = F.col("_v")
    parsed = lines.withColumn("_v", F.try_parse_json(F.col(value)))
    at = lambda image, f: f"$.{image}['{f.name}']"
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    whole = lambda image: F.try_variant_get(v, f"$.{image}", "variant")
    there = lambda image: whole(image).isNotNull() & ~F.is_variant_null(whole(image))
    row = lambda image: F.when(there(image), F.struct(*(get(at(image, f), f.dataType.simpleString()).alias(f.name) for f in fields)))
    misfit = lambda image, f: F.when(get(at(image, f), "string").isNotNull() & get(at(image, f), f.dataType.simpleString()).isNull(), F.lit(f"{image}.{f.name}"))
    errors = F.when(v.isNull(), F.array(F.lit("json"))).otherwise(F.array_compact(F.array(*(misfit(image, f) for image in ("before", "after") for f in fields))))
    rest = [c for c in lines.columns if c != value]
    head = [get(f"$.{n}", "string").alias(n) for n in ("database", "tableName", "type")]
    marked = parsed.withColumn("errors", errors)
    good = marked.where(F.size("errors") == 0).select(*rest, *head, row("before").alias("before"), row("after").alias("after"))
    return good, marked.where(F.size("errors") > 0).select(*lines.columns, "errors")


def filter_columns(df: DataFrame) -> DataFrame:
    """Keeps those entries of `after` that the rule lists; names are neither trimmed nor folded. A typed image keeps its columns
    and loses the values of those that aren't listed."""
    image = df.schema["after"].dataType
    if isinstance(image, T.StructType):
        listed = lambda n: F.array_contains(F.split("sinkColumns", ","), n)
        return df.withColumn("after", F.when(F.col("after").isNotNull(), F.struct(*(F.when(listed(n), F.col("after")[n]).alias(n) for n in image.names))))
    return df.withColumn("after", F.map_filter("after", lambda k, _: F.array_contains(F.split("sinkColumns", ","), k)))


def latest_by_key(df: DataFrame, pk: str = "id", seq: Column | str = "seq", columns: list[str] | None = None, null_overwrites: bool = False) -> DataFrame:
    """State of a table after all upserts: per key and column the latest value that isn't null, or just the latest."""
    order = F.col(seq) if isinstance(seq, str) else seq
    names = columns or [c for c in df.columns if c not in (pk, seq)]

    def last(c: str) -> Column:
        value = F.struct(F.col(c).alias("v"))
        return F.max_by(value, order if null_overwrites else F.when(F.col(c).isNotNull(), order))["v"]

    return df.groupBy(pk).agg(*(last(c).alias(c) for c in names))


def project_dim_schema(df: DataFrame, columns: str, pk: str = "id") -> DataFrame:
    """Dimension columns as text, in the rule's order; rows without a key can't be stored."""
    return df.select(*(F.col("after")[c].cast("string").alias(c) for c in columns.split(","))).where(F.col(pk).isNotNull())


def to_retract(df: DataFrame) -> DataFrame:
    """Retract stream of a change log: (flag, row), with two rows for an update."""
    row = lambda flag, image: F.struct(F.lit(flag).alias("flag"), F.col(image).alias("row"))
    rows = (
        F.when(F.col("type").isin("insert", "read"), F.array(row(True, "after"))).when(F.col("type") == "update", F.array(row(False, "before"), row(True, "after")))
        .when(F.col("type") == "delete", F.array(row(False, "before"))))
    rest = [c for c in df.columns if c not in ("before", "after", "type")]
    return df.select(*rest, F.posexplode(rows).alias("step", "r")).select(*rest, "step", "r.flag", "r.row")


def replay(df: DataFrame, pk: str = "id", seq: str = "seq") -> DataFrame:
    """Current table of a snapshot and its change log; a key whose last event is a delete is gone."""
    key = F.coalesce(F.col("after")[pk], F.col("before")[pk])
    last = df.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct("type", "after"), seq).alias("r"))
    return last.where("r.type <> 'delete'").select(F.col("_key").alias(pk), F.col("r.after").alias("row"))
