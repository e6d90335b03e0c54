"""Connected components of a table of links, without collecting links, stars or components anywhere.

Each round every node moves to the neighbour (or itself) with the smallest hash of that round, and the links are drawn
anew between the places moved to; a constant share of the nodes goes in each round, whatever the graph's shape, so a
long chain takes as few rounds as a star. The moves are kept and applied one after the other at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that has a link to another, with the smallest id reachable. Loops and repeats are fine."""
    spark = links.sparkSession
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges, path = common.stored(edges, "edges")
    moves: DataFrame | None = None
    paths, n = [path], 0
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, n=n: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("id"))
        to = ends.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = to.select("a", F.least(F.col("m"), rank("a"))["id"].alias("m"))
        to, path = common.stored(to, "moves")
        paths.append(path)
        moved = edges.join(to.withColumnRenamed("m", "x"), "a").select("b", "x")
        moved = moved.join(to.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        edges, path = common.stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        paths.append(path)
        moves = to.select(F.col("a").alias("id"), F.col("m").alias("at")) if moves is None else (
            moves.join(to.select(F.col("a").alias("at"), F.col("m").alias("next")), "at", "left").select("id", F.coalesce("next", "at").alias("at")))
        if n % 3 == 2:
            moves, path = common.stored(moves, "places")
            paths.append(path)
        n += 1
    if moves is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    places = common.written(moves, "places")
    least = places.groupBy("at").agg(F.min("id").alias("component"))
    out = common.written(places.join(least, "at").select("id", "component"), "components")
    for p in paths:
        common.discard(spark, p)
    return out
