"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; nothing is gathered anywhere but counts. Edges that a hub has by the
thousand are spread by skewed-join splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node reachable, for every node of ``edges`` (columns a, b) but the least
    nodes themselves. Loops and repeated edges are harmless; an empty table gives none. Only the last round's table
    stays."""
    tables = shared.Tables(edges.sparkSession)
    now = tables.write("edges-0", edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, k = _state(now), 0
    while state[0]:
        now = tables.write(f"edges-{k + 1}", _small(_large(now)))
        tables.drop(f"edges-{k}")
        before, state, k = state, _state(now), k + 1
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
