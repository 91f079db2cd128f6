"""Score reports and classifier metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.sampling import running_sums, with_range, with_rank


def score_means(scores: DataFrame, group: str, score: str = "score", digits: int | None = 3) -> DataFrame:
    """Column means of score arrays by group and in total (group null), one pass: group, pos, mean, n.

    Arrays of a group may differ in length: only columns that every row of the group has count, as when rows are zipped.
    """
    wide = scores.where(F.size(score) > 0).select(group, score)
    shortest = wide.groupBy(group).agg(F.min(F.size(score)).alias("__short"))
    overall = wide.agg(F.min(F.size(score)).alias("__all"))
    long = wide.select(group, F.posexplode(score).alias("pos", "v"))
    out = long.groupingSets([(group, "pos"), ("pos",)], group, "pos").agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.grouping(group).alias("__total"))
    out = out.join(shortest.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__total") == 0), "left").crossJoin(F.broadcast(overall))  # one row
    out = out.where(F.col("pos") < F.when(F.col("__total") == 1, F.col("__all")).otherwise(F.col("__short")))
    mean = F.round("mean", digits) if digits is not None else F.col("mean")
    return out.select(F.when(F.col("__total") == 1, "total").otherwise(F.col(group)).alias(group), "pos", mean.alias("mean"), "n")


def with_sum(means: DataFrame, group: str) -> DataFrame:
    """Adds, for groups of two columns, a row pos = 2 with the sum of their means."""
    sums = means.groupBy(group).agg(F.count("*").alias("k"), F.sum("mean").alias("mean"), F.max("n").alias("n")).where("k = 2")
    return means.unionByName(sums.select(group, F.lit(2).alias("pos"), F.round("mean", 3).alias("mean"), "n"))


def overall(sc: Column, pq: Column) -> Column:
    """Geometric mean of the smallest scores of two judges."""
    return F.sqrt(F.array_min(sc).cast("double") * F.array_min(pq).cast("double"))


def average_precision(df: DataFrame, group: list[str], score: str, target: str, key: str, eps: float = 1e-8) -> DataFrame:
    """AP of each group: precisions at the positives in falling score (null last, ties by key), over their number plus eps.

    Positives and ranks are running sums over ranges of the order, so a group of any size is dealt to many tasks.
    """
    rows = df.select(*group, F.col(score).isNull().alias("__none"), (-F.col(score)).alias("__down"), F.col(key).alias("__key"), F.col(target).alias("__y"))
    rows = running_sums(rows, group, ["__none", "__down", "__key"], {"__hits": F.col("__y").cast("double"), "__rank": F.lit(1)})
    positive = F.col("__y") == 1
    return rows.groupBy(*group).agg((F.sum(F.when(positive, F.col("__hits") / F.col("__rank")).otherwise(0.0)) / (F.sum(F.col("__y").cast("double")) + eps)).alias("ap"))


def mean_average_precision(aps: DataFrame) -> DataFrame:
    return aps.agg(F.coalesce(100 * F.avg("ap"), F.lit(0.0)).alias("map"))


def running_mean(value: str, n: str) -> Column:
    return F.sum(F.col(value) * F.col(n)) / F.sum(n)


def running_ema(order: list[str], value: str, keep: float = 0.99) -> Column:
    """The last exponential average, seeded with the first value.

    A fold over one group's values in order; groups should be series of moderate length (see `ema`).
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))), lambda x: x["__v"])
    return F.aggregate(F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0))), F.get(seq, F.lit(0)), lambda a, x: a * keep + x * (1 - keep))


def ema(df: DataFrame, group: str, order: list[str], value: str, keep: float = 0.99) -> DataFrame:
    """The same average for series of any length: (group, ema).

    With r rows after a value its weight is (1-keep)*keep**r, and keep**r for the first. A series is cut into ranges of
    its order, each summed on its own; a sum then counts by the rows in the ranges after it.
    """
    rows = with_range(df.select(group, *order, F.col(value).cast("double").alias("__v")), [group, *order], "__range")
    w = Window.partitionBy(group, "__range").orderBy(*order)
    rows = rows.select(group, "__range", "__v", F.row_number().over(w).alias("__k"), F.count("*").over(Window.partitionBy(group, "__range")).alias("__n"))
    power = lambda c: F.pow(F.lit(keep), c)
    parts = rows.groupBy(group, "__range").agg(
        F.max("__n").alias("__n"), F.sum(F.col("__v") * (1 - keep) * power(F.col("__n") - F.col("__k"))).alias("__s"), F.max(F.when(F.col("__k") == 1, F.col("__v"))).alias("__first")
    )
    later = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))  # one row a range
    head = F.row_number().over(Window.partitionBy(group).orderBy("__range")) == 1
    parts = parts.select(group, "__n", "__s", "__first", later.alias("__later"), head.alias("__head"))
    seed = F.when(F.col("__head"), keep * power(F.col("__n") - 1) * F.col("__first")).otherwise(0.0)
    return parts.groupBy(group).agg(F.sum((F.col("__s") + seed) * power(F.col("__later"))).alias("ema"))


def dispersive_loss(df: DataFrame, vector: str, task: str, key: str, batch: str, temperature: float = 0.5, eps: float = 1e-8, most: int = 8192) -> DataFrame:
    """For each training batch: mean over rows of -ln(sum of same-task kernels / sum of kernels), kernels exp(-d^2 / temperature) of unit vectors; self counts below only.

    Rows (batch, loss, n). All pairs of a batch are what the loss is defined on: one matrix product in one task, in
    blocks of rows. A batch of over `most` rows is an error, for such a table isn't made of training batches.
    """
    rows = df.select(F.col(batch).cast("long").alias("b"), F.col(key).alias("k"), F.col(task).cast("long").alias("t"), F.col(vector).cast("array<double>").alias("v"))

    def loss(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"batch {frame['b'].iloc[0]} has {len(frame)} rows, over {most}")
        x, t = np.stack(frame["v"].to_numpy()), frame["t"].to_numpy()
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        total = 0.0
        for at in range(0, len(x), 512):
            e = np.exp(-np.maximum(2 - 2 * x[at : at + 512] @ x.T, 0) / temperature)
            own = np.arange(len(e))
            e[own, own + at] = 1.0
            same = t[at : at + 512, None] == t[None, :]
            same[own, own + at] = False
            total += float(-np.log(((e * same).sum(axis=1) + eps) / (e.sum(axis=1) + eps)).sum())
        return pd.DataFrame({"batch": [frame["b"].iloc[0]], "loss": [total / len(x)], "n": [len(x)]})

    return rows.groupBy("b").applyInPandas(loss, "batch long, loss double, n long")


def accumulated_loss(losses: DataFrame, step: str, process: str, loss: str, accumulate: int) -> DataFrame:
    """(update, loss): the mean over processes at each step (from 0), then the mean over the steps of one update."""
    means = losses.groupBy(step).agg(F.avg(loss).alias("__mean"))
    return means.groupBy(F.floor(F.col(step) / accumulate).alias("update")).agg((F.sum("__mean") / accumulate).alias("loss"))


def expert_load(df: DataFrame, expert: str, prob: str) -> DataFrame:
    """Share of tokens and mean gate probability of each expert, with the offset of its tokens in expert order."""
    counts = df.groupBy(expert).agg(F.count("*").alias("tokens"), F.avg(prob).alias("mean_prob"))
    w = Window.orderBy(expert)  # as many rows as experts
    total = F.sum("tokens").over(Window.partitionBy())
    offset = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return counts.select(expert, "tokens", (F.col("tokens") / total).alias("load"), "mean_prob", offset.alias("offset"))


def top_experts(probs: Column, k: int) -> Column:
    """The k largest of an array as (prob, expert), first of ties first."""
    ranked = F.transform(probs, lambda p, i: F.struct((-p).alias("o"), i.alias("expert"), p.alias("prob")))
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda s: F.struct(s["prob"].alias("prob"), s["expert"].alias("expert")))


def vocabulary(df: DataFrame, labels: str) -> DataFrame:
    """Sorted distinct labels with their index from 0, numbered over ranges."""
    found = df.select(F.explode(labels).alias("label")).distinct()
    return with_rank(found, ["label"], "__rank").select("label", (F.col("__rank") - 1).cast("int").alias("label_id"))


def relevant(labels: Column, classes: list) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, classes)))


def largest_region(df: DataFrame, group: list[str], area: str, order: str, value: str) -> DataFrame:
    """The value of the largest area in each group, the first of ties."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(F.col(area), -F.col(order))).alias(value), F.max(area).alias(area))


def mean_pool(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the group's vectors."""
    parts = df.select(*group, F.posexplode(vector).alias("__i", "__v")).groupBy(*group, "__i").agg(F.avg("__v").alias("__m"))
    return parts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda x: x["__m"]).alias(vector))


def mask_stats(bits: Column, other: Column | None = None) -> Column:
    """struct(area, ratio, overlap) of 0/1 arrays."""
    area = F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x)
    both = F.aggregate(F.zip_with(bits, other, lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x) if other is not None else F.lit(None).cast("long")
    return F.struct(area.alias("area"), F.try_divide(area, F.size(bits)).alias("ratio"), both.alias("overlap"))


def rolling_share(df: DataFrame, order: list[str], kind: str, last: int = 1000) -> DataFrame:
    """Share of each row's own kind among the last `last` rows up to it.

    The window slides over one ordered series; for long series rows are dealt to blocks of `last`, each with the
    block before it, so that windows stay within one group of two blocks.
    """
    ranked = with_rank(df, order, "__rank")
    block = F.floor((F.col("__rank") - 1) / last)
    twice = ranked.withColumn("__own", block).withColumn("__block", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy("__block").orderBy("__rank").rowsBetween(-(last - 1), 0)
    # within a pair of blocks, a row of the later one has its whole window
    counted = twice.withColumns({"__all": F.count("*").over(w), "__same": F.lit(0)})
    same = F.count("*").over(Window.partitionBy("__block", kind).orderBy("__rank").rangeBetween(-(last - 1), 0))
    return counted.withColumn("__same", same).where("__block = __own").withColumn("share", F.col("__same") / F.col("__all")).drop("__rank", "__own", "__block", "__all", "__same")


def last_of_kind(items: Column) -> Column:
    """The last image and the last text of an ordered array of (kind, value)."""
    last = lambda k: F.try_element_at(F.filter(items, lambda x: x["kind"] == k), F.lit(-1))["value"]
    return F.struct(last("image").alias("image"), last("text").alias("text"))


def folded_context(items: Column) -> Column:
    """Left fold of ordered (kind, value): the context after everything, and the one in front of the last text."""
    start = F.struct(F.lit("").alias("context"), F.lit("").alias("before_text"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["kind"] == "text", F.concat(F.lit("[t:"), x["value"], F.lit("]"))).when(x["kind"] == "image", F.concat(F.lit("[i:"), x["value"], F.lit("]"))).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), x["kind"])))
        return F.struct(F.concat(acc["context"], mark).alias("context"), F.when(x["kind"] == "text", acc["context"]).otherwise(acc["before_text"]).alias("before_text"))

    return F.aggregate(items, start, step)
