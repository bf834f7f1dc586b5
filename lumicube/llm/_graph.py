"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._spark import cut, hot_keys, salted_join, scrap


#: From so many pairs on the arcs of hubs are dealt over tasks; a task holds fewer without that.
MIN_DEALT = 1_000_000


def _step(pairs: DataFrame, small: bool, dealt: bool) -> DataFrame:
    """One star step; the minimum of a neighbourhood is a partial aggregate and the arcs of a hub are dealt over tasks,
    so no large neighbourhood is ever gathered."""
    if small:
        arcs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = arcs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    one = least.drop("n")
    both = salted_join(arcs, one, ["u"], hot_keys(least, ["u"]), ["v"]) if dealt else arcs.join(one, "u")
    if small:
        out = both.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        out = both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _state(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node on an edge (columns a, b): comp is the smallest node that it reaches.

    Loops, repeated and reversed edges are fine; null ends are dropped;
    no edges give no rows.  Each round is written to the shared checkpoint folder and the round before is deleted;
    only two numbers a round reach the driver.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = _state(pairs)
    while seen[0]:
        dealt = seen[0] >= MIN_DEALT
        nxt = cut(_step(_step(pairs, False, dealt), True, dealt))
        now, before, pairs = _state(nxt), pairs, nxt
        scrap(before)
        if now == seen:
            break
        seen = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(stars.select("comp").distinct().select(F.col("comp").alias("node"), F.col("comp").alias("comp")))
