"""Connected components of a table of links, by alternating stars.

Each round joins every node's neighbours to the least of them (larger ones first,
then smaller ones), which keeps the components and lets them end as stars in few
rounds (Kiveris et al., 2014). A round's links are written to the shared folder, so
lineage stays short and a lost executor costs one round at most. Hubs are joined as
common.attach says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _linked(rows: DataFrame, n: int) -> DataFrame:
    """u, v, m with m the least of u and its neighbours v."""
    least = rows.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("size")).select("u", F.least("u", "low").alias("m"), "size")
    return common.attach(rows, least, "u", "size", n).select("u", "v", "m")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). node, component (its least node) of every node that has a link."""
    held = common.materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(held)
    if not state[0]:
        return held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:  # labels only fall, so it ends
        both = held.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(held.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _linked(both, 2 * state[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.materialise(large, "links")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        small = _linked(down, state[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own).distinct()
        held = common.materialise(small, "links")
        last, state = state, _state(held)
        if state == last:
            break
    roots = held.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
