"""Bucket-homogeneous batches and weighted mixing of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.sampling import draw, running_sums


def check_weights(weights: dict) -> dict:
    """Positive weights, scaled to add up to one."""
    if not weights:
        raise ValueError("at least one weight is needed")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def batches(df: DataFrame, bucket: str, size: int, seed: str, key: str, keep_tail: bool = False) -> DataFrame:
    """Adds batch (number within the bucket) and slot: every batch has `size` rows of one bucket.

    Rows of a bucket come in hashed order. Only the last, partial batch of a bucket goes, unless keep_tail.
    Buckets can be few, so rows are numbered within (bucket, shard), shards being dealt by hash; what remains of
    the shards' last batches is numbered once more within the bucket (fewer rows than shards times size).
    """
    if size < 1:
        raise ValueError("size must be positive")
    shards = 64
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    dealt = df.withColumn("__order", order).withColumn("__shard", F.pmod(F.conv(F.substring("__order", 25, 8), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    number = F.row_number().over(Window.partitionBy(bucket, "__shard").orderBy("__order", key)) - 1
    count = F.count("*").over(Window.partitionBy(bucket, "__shard"))
    dealt = dealt.withColumns({"__n": number, "__count": count}).withColumn("__full", F.col("__n") < F.floor(F.col("__count") / size) * size)
    full = dealt.where("__full").withColumn("__batch", F.concat(F.lpad(F.col("__shard").cast("string"), 3, "0"), F.lit("-"), F.lpad(F.floor(F.col("__n") / size).cast("string"), 12, "0"))).withColumn("slot", (F.col("__n") % size).cast("int"))
    rest = dealt.where("NOT __full").withColumn("__m", F.row_number().over(Window.partitionBy(bucket).orderBy("__order", key)) - 1).withColumn("__left", F.count("*").over(Window.partitionBy(bucket)))
    if not keep_tail:
        rest = rest.where(F.col("__m") < F.floor(F.col("__left") / size) * size)
    rest = rest.withColumn("__batch", F.concat(F.lit("rest-"), F.lpad(F.floor(F.col("__m") / size).cast("string"), 12, "0"))).withColumn("slot", (F.col("__m") % size).cast("int"))
    out = full.drop("__m", "__left").unionByName(rest.drop("__m", "__left"))
    return out.withColumnRenamed("__batch", "batch").drop("__order", "__shard", "__n", "__count", "__full")


def multiplexed(batched: DataFrame, bucket: str, weights: dict, seed: str) -> DataFrame:
    """Orders batches so that, at any point, buckets come in proportion to the weights of those that still have batches.

    A batch's place is the sum of exponential waits of its bucket's rate, a Poisson race, which draws by the
    weights and renormalises when a bucket is exhausted. Adds position (double); sort by (position, bucket, batch, slot).
    """
    rates = check_weights(weights)
    rate = F.create_map(*[x for k, w in rates.items() for x in (F.lit(k), F.lit(w))])[F.col(bucket)]
    heads = batched.select(bucket, "batch").distinct().withColumn("__wait", -F.log(draw(seed, F.concat_ws("/", F.col(bucket).cast("string"), F.col("batch")))) / rate)
    # batches are named by shard and number, so shards cut a bucket in the order of names
    heads = running_sums(heads.withColumn("__shard", F.substring_index("batch", "-", 1)), [bucket], ["batch"], {"position": F.col("__wait")}, "__shard").drop("__wait", "__shard")
    return batched.join(heads, [bucket, "batch"])


def collated(batched: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """One row a batch: its rows' columns as arrays in order of their slots."""
    rows = F.array_sort(F.collect_list(F.struct("slot", *columns)))  # as many as a batch has
    return batched.groupBy(bucket, "batch").agg(rows.alias("__rows")).select(bucket, "batch", *[F.col("__rows").getField(c).alias(c) for c in columns])


def dealt_twice(rank: Column, nodes: int, workers: int) -> Column:
    """struct(node, worker): rows go to nodes in turn, and those of a node to its workers in turn; ranks from 1."""
    return F.struct(F.pmod(rank - 1, F.lit(nodes)).cast("int").alias("node"), F.pmod(F.floor((rank - 1) / nodes), F.lit(workers)).cast("int").alias("worker"))


def round_robin(rank: Column, n: int) -> Column:
    """0, 1, ..., n-1, 0, ... for ranks from 1."""
    return F.pmod(rank - 1, F.lit(n)).cast("int")


def strided(df: DataFrame, rank: str, workers: int, worker: int) -> DataFrame:
    """Every workers-th row from `worker` on."""
    if not 0 <= worker < workers:
        raise ValueError("worker must be between 0 and workers - 1")
    return df.where(round_robin(F.col(rank), workers) == worker)


def classed(df: DataFrame, kind: Column, classes: int, drop_none: bool = True) -> DataFrame:
    """Adds `child`, the class of each row; a class out of range raises, null goes or raises."""
    bad = F.raise_error(F.concat(F.lit("class "), kind.cast("string"), F.lit(" out of range"))).cast("int")
    none = F.lit(None).cast("int") if drop_none else F.raise_error(F.lit("class is null")).cast("int")
    marked = df.withColumn("child", F.when(kind.isNull(), none).when((kind < 0) | (kind >= classes), bad).otherwise(kind.cast("int")))
    return marked.where("child IS NOT NULL")


def demultiplexed(df: DataFrame, kind: Column, classes: int, path: str, drop_none: bool = True) -> dict[int, DataFrame]:
    """One frame for each class. The input is read once, into a folder a class; a frame opens its own folder alone.

    For children that ask in turn, with bounded buffers, see operators.demux.
    """
    classed(df, kind, classes, drop_none).write.partitionBy("child").parquet(path)
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("child", T.IntegerType())])).parquet(path)
    return {i: written.where(F.col("child") == i).drop("child") for i in range(classes)}
