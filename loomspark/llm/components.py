"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checkpoint

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of a link; component is the smallest node reachable.

    Each round is two aggregations and two equi-joins; rows of a busy node are pre-aggregated, and the skew
    join splits them. Every round is written to the shared checkpoint folder. Nothing but two numbers a round
    reaches the driver. Links to null or to oneself are ignored.
    """
    rows = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v").distinct()
    rows = checkpoint(rows)
    seen = None
    for _ in range(MAX_ROUNDS):
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pairs = F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m")), F.struct(F.col("v").alias("x"), F.col("m")))).alias("p")
        rows = checkpoint(small.select(pairs).select(F.col("p.x").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
