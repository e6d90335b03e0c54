"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row by coordinate lookups.

Leaves get their place in the group by a range sort. The tree grows in bands: runs of 2^BAND neighbours lie together and
grow BAND levels at once, their tops are the leaves of the next band. All nodes are written with their coordinates (tree,
level, place). A proof explodes the coordinates of the siblings that a place and the size of its tree require, joins the
node table, orders what came back by level, concatenates and folds it. Paths are looked up band by band: within a band a
node is the sibling of at most 2^BAND places, and what lies above the band is looked up once for its whole run, so
that neither a large group nor a node near a root is a hot key.

Rows are compared as they are: repeated rows are leaves of their own next to each other, null ids come first in their
group, a null group is a group before all others, and an empty table has no tree and no rows. Texts that aren't UTF-8 count
by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Levels of a band: a run has 2^BAND places, whatever the input's size.
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    """A field's image: `-` if null, else its length in bytes, a colon and the value."""
    raw = value.cast("string").cast("binary")
    return F.coalesce(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(":").cast("binary"), raw), F.lit("-").cast("binary"))


def leaves(df: DataFrame, key: str, group: str, fields: tuple[str, ...], changed: dict[str, Column], when: Column) -> DataFrame:
    """(key, group, leaf, tampered): each row's digest, and its digest with `changed` columns where `when` holds."""
    image = lambda new: digest(*(field(new.get(c, F.col(c))) for c in fields))
    return df.select(F.col(key).alias("key"), F.col(group).alias("tree"), image({}).alias("leaf"), F.when(when, image(changed)).alias("tampered"))


def height(size: str | Column) -> Column:
    """Levels above the leaves of a tree: the least h with 2^h >= size."""
    n = F.col(size) if isinstance(size, str) else size
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def grow(nodes: DataFrame, base: int) -> DataFrame:
    """The next band over (tree, height, place, node), nodes of level `base`: (tree, height, place, level, node) of all levels
    in it, from `base` on to its top. A run of at most 2^BAND nodes grows within one row; a last run of one goes on alone."""
    runs = nodes.groupBy("tree", "height", F.shiftright("place", BAND).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("all"))
    above = lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda k: F.sha2(F.concat(F.get(a, 2 * k), F.coalesce(F.get(a, 2 * k + 1), F.lit(""))).cast("binary"), 256))
    steps = F.least(F.col("height") - base, F.lit(BAND))
    start = F.array(F.transform("all", lambda s: s["node"]))
    levels = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))).otherwise(start)
    long = runs.select("tree", "height", "run", F.posexplode(levels).alias("up", "row"))
    long = long.select("tree", "height", "run", "up", F.posexplode("row").alias("k", "node"))
    place = F.expr(f"shiftleft(run, {BAND} - up) + k")
    return long.select("tree", "height", place.alias("place"), (F.col("up") + base).alias("level"), "node")


def siblings(band: DataFrame, places: DataFrame, base: int) -> DataFrame:
    """(tree, place, steps): for each place of level `base`, the steps of its band from below: the sibling's digest (null where
    there is none, at the end of a level) and whether it stands on the left. Required coordinates are exploded from place and
    size of the tree, joined to the node table and put in order."""
    ups = F.when(F.col("height") > base, F.sequence(F.lit(0), F.greatest(F.least(F.col("height") - base, F.lit(BAND)), F.lit(1)) - 1))
    asked = places.select("tree", "place", "size", F.explode(ups).alias("up"))
    own = F.expr("shiftright(place, up)")
    last = F.expr(f"shiftright(size - 1, up + {base})")  # the last place of that level
    other = own.bitwiseXOR(F.lit(1).cast("long"))
    asked = asked.select("tree", "place", (F.col("up") + base).alias("level"), F.when(other <= last, other).alias("other"), (own % 2 == 1).alias("left"))
    nodes = band.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("place").alias("_place"), "node")
    found = asked.join(nodes, (F.col("tree") == F.col("_tree")) & (F.col("level") == F.col("_level")) & (F.col("other") == F.col("_place")), "left")
    return found.groupBy("tree", "place").agg(F.sort_array(F.collect_list(F.struct("level", "node", "left"))).alias("steps"))


STEPS = "array<struct<level:int,node:string,left:boolean>>"


def forest(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(rows' columns, top, steps): each row's root and its way there, for a tree over each group `tree` of digests `leaf`.
    `tree` must not be null here."""
    spark = rows.sparkSession
    made, paths = common.placed(rows, order)
    made, path = common.stored(made.withColumn("height", height("size")), "placed")
    paths.append(path)
    most = made.agg(F.max("height")).first()[0] or 0
    nodes = made.select("tree", "height", "place", F.col("leaf").alias("node"))
    tables, sizes, base = [], made.select("tree", "height", "size", "place"), 0
    looked = []
    while True:
        band, path = common.stored(grow(nodes, base), f"nodes-{base}")
        paths.append(path)
        tables.append(band)
        steps, path = common.stored(siblings(band, sizes, base), f"steps-{base}")
        paths.append(path)
        looked.append(steps)
        if base + BAND >= most:
            break
        base += BAND
        nodes = band.where((F.col("level") == base) & (F.col("height") >= base)).select("tree", "height", "place", "node")
        # a run's top stands for it: its place one band up is the run's number
        one_each = sizes.where(F.col("height") >= base).where(F.expr(f"place % {1 << BAND} = 0"))
        sizes = one_each.select("tree", "height", "size", F.shiftright("place", BAND).alias("place"))
    # from above: the way of a run is looked up once and appended to the ways of its places
    way = looked[-1]
    for lower in reversed(looked[:-1]):
        up = way.select(F.col("tree").alias("_tree"), F.col("place").alias("_run"), F.col("steps").alias("_more"))
        on = (F.col("tree") == F.col("_tree")) & (F.shiftright("place", BAND) == F.col("_run"))
        way = lower.join(up, on, "left").select("tree", "place", F.concat("steps", F.coalesce("_more", F.array().cast(STEPS))).alias("steps"))
    tops = tables[0].where("level = height") if len(tables) == 1 else _tops(tables)
    tops = tops.select(F.col("tree").alias("_tree"), F.col("node").alias("top"))
    way = way.select(F.col("tree").alias("_wt"), F.col("place").alias("_wp"), "steps")
    out = made.join(way, (F.col("tree") == F.col("_wt")) & (F.col("place") == F.col("_wp")), "left").join(common.small(tops), F.col("tree") == F.col("_tree"))
    out = out.withColumn("steps", F.coalesce("steps", F.array().cast(STEPS)))
    return out.drop("_wt", "_wp", "_tree", "place", "size", "height", "row"), paths


def _tops(tables: list[DataFrame]) -> DataFrame:
    """Roots: the node at a tree's own height, in the band where it is made (a band's first level is the last of the one before)."""
    out = None
    for k, t in enumerate(tables):
        rows = t.where((F.col("level") == F.col("height")) & ((F.col("level") > k * BAND) | (F.lit(k) == 0)))
        out = rows if out is None else out.unionByName(rows)
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.when(s["node"].isNull(), acc).when(s["left"], F.concat(s["node"], acc)).otherwise(F.concat(acc, s["node"])).cast("binary"), 256))


def proof(steps: Column) -> Column:
    """Digest of the siblings, from the leaf's level up."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["node"]), "").cast("binary"), 256)


def manifest(rows: DataFrame) -> DataFrame:
    """(key, tree, leaf, tampered, subroot, root, steps) of (key, tree, leaf, tampered). Trees are ordered by their group's
    bytes, null first; group names are compared with nulls apart by a mark before them."""
    marked = rows.withColumn("group", F.col("tree")).withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")))
    low, paths = forest(marked, ("key", "leaf"))
    low, path = common.stored(low.withColumnsRenamed({"top": "subroot", "steps": "low"}), "subroots")
    spark = rows.sparkSession
    for p in paths:
        common.discard(spark, p)
    # of the rows of a tree one is at place 0; a count per tree is all that the upper tree needs
    trees = low.groupBy("tree").agg(F.min("subroot").alias("leaf")).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaf")
    high, paths = forest(trees, ("name",))
    high, _ = common.stored(high.select("name", F.col("top").alias("root"), F.col("steps").alias("high")), "roots")
    for p in paths:
        common.discard(spark, p)
    out = low.join(common.small(high), F.col("tree") == F.col("name"))
    return out.select("key", F.col("group").alias("tree"), "leaf", "tampered", "subroot", "root", F.concat("low", "high").alias("steps"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for every document, a tree for each language. Where 7 divides the CRC-32 of the id, the leaf is also computed
    with one more character in n_chars; a null id is never tampered with."""
    docs = common.table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = leaves(docs, "doc_id", "lang", FIELDS, {"n_chars": F.col("n_chars") + 1}, hit)
    found = manifest(rows)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
