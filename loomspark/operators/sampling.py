"""Seeded sampling. Every draw is a hash of seed and key, so it doesn't depend on order, partitions or retries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that are drawn for each range of a global order, to find its border.
DRAWN = 16
#: Rows of a group that one task may sum up, and first rows of an order that one task may merge.
LARGE_GROUP = 1_000_000
MERGED = 10_000


def draw(seed: str, key: Column, salt: str = "") -> Column:
    """A uniform double strictly between 0 and 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}{salt}"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 1) / 4294967297.0


def draw_int(seed: str, key: Column, n: Column, salt: str = "") -> Column:
    """A whole number from 0 to n-1."""
    digest = F.md5(F.concat(F.lit(f"{seed}{salt}"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long")).cast("int")


def coin(seed: str, key: Column, p: float) -> Column:
    return draw(seed, key) < p


def pick_one(seed: str, key: Column, values: Column) -> Column:
    """One element of an array; null for an empty one."""
    return F.when(F.size(values) > 0, F.get(values, draw_int(seed, key, F.size(values))))


def caption_choice(seed: str, key: Column, captions: Column, blank: float = 0.1) -> Column:
    """One caption of several, or a blank in a share of cases."""
    return F.when(draw(seed, key, "blank") < blank, " ").otherwise(pick_one(seed, key, captions))


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    """All rows in an order that only seed and key decide."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def draws_with_replacement(seed: str, key: Column, values: Column, k: int) -> Column:
    """k draws from an array, repeats dropped (1 to k survive)."""
    return F.array_distinct(F.array(*[F.get(values, draw_int(seed, key, F.size(values), str(i))) for i in range(k)]))


def draws_without_replacement(seed: str, key: Column, values: Column, n: int) -> Column:
    """min(n, size) different elements."""
    hashed = F.transform(values, lambda v, i: F.struct(F.md5(F.concat(F.lit(seed), key.cast("string"), F.lit("/"), i.cast("string"))).alias("o"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(hashed), 1, n), lambda s: s["v"])


def weighted_sample(df: DataFrame, seed: str, key: str, weight: Column, n: int) -> DataFrame:
    """n rows without replacement, drawn in proportion to weight: the n smallest -ln(u)/w. Rows of no weight never come."""
    return smallest(df.where(weight > 0).withColumn("__order", -F.log(draw(seed, F.col(key))) / weight), ["__order", key], n).drop("__order")


def smallest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the given order (nulls first), however large n is.

    Up to MERGED rows are each task's first ones, merged. For more, rows are dealt to ranges and the ranges counted; those
    that lie behind the n-th row go before anything is sorted.
    """
    if n <= MERGED:
        return df.orderBy(*order).limit(n)
    dealt, counts = _counted(df, order)
    within = dealt.join(F.broadcast(counts.where(F.col("__before") < n)), F.col("__range") == F.col("__r"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return within.withColumn("__local", local).where(F.col("__before") + F.col("__local") <= n).drop("__range", "__local", "__r", "__before")


def inverse_frequency(df: DataFrame, kind: str) -> DataFrame:
    """Each kind's share and the weight 1 - share."""
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(kind, "n", (F.col("n") / F.col("total")).alias("share"), (1 - F.col("n") / F.col("total")).alias("weight"))  # total is one row


def split_by_hash(seed: str, key: Column, shares: dict[str, float]) -> Column:
    """Names of parts, dealt by hash; shares must add up to one."""
    if abs(sum(shares.values()) - 1) > 1e-9 or any(s < 0 for s in shares.values()):
        raise ValueError("shares must be non-negative and add up to 1")
    u, out, reached = draw(seed, key), None, 0.0
    for name, share in shares.items():
        reached += share
        out = F.when(u < reached, name) if out is None else out.when(u < reached, name)
    return out.otherwise(next(reversed(shares)))


def contiguous_split(df: DataFrame, n: int, order: list[str], out: str = "part") -> DataFrame:
    """n parts of near equal size in the given order, the first ones larger by one.

    Ranks come from counts of ordered ranges rather than from one sorted task: rows are range-partitioned,
    ranges are counted (one row each), and offsets are joined back.
    """
    ranked = with_rank(df, order, "__rank")
    total = df.agg(F.count("*").alias("__total"))
    size, more = F.floor(F.col("__total") / n), F.col("__total") % n
    border = more * (size + 1)
    r = F.col("__rank") - 1
    part = F.when(r < border, F.floor(r / (size + 1))).otherwise(more + F.floor((r - border) / F.greatest(size, F.lit(1))))
    return ranked.crossJoin(F.broadcast(total)).withColumn(out, part.cast("int")).drop("__rank", "__total")  # total is one row


def with_range(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Deals rows to ranges of the order columns, whatever their types (nulls first): `out` grows with the order.

    There are about two ranges for each shuffle partition. Their borders are quantiles of the DRAWN rows a range that
    have the least hash: they decide how even the ranges are, nothing else. Rows that agree in all order columns share
    a range.
    """
    side = min(64, max(4, math.isqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    ranges = side * side
    key = F.struct(*order)
    drawn = df.select(key.alias("__key"), F.xxhash64(*order).alias("__hash")).orderBy("__hash").limit(DRAWN * ranges)
    drawn = drawn.agg(F.sort_array(F.collect_list("__key")).alias("__all"))  # at most DRAWN rows a range
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("__all", F.floor(F.size("__all") * i / ranges).cast("int")))
    borders = drawn.select(at.alias("__b"), F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get(at, i * side - 1)).alias("__wide"))
    # first among every side-th border, then among those that follow it
    wide = F.size(F.filter("__wide", lambda x: x < key))
    number = wide * side + F.size(F.filter(F.slice("__b", wide * side + 1, side - 1), lambda x: x < key))
    return df.crossJoin(F.broadcast(borders)).withColumn(out, number).drop("__b", "__wide")  # borders are one row


def _counted(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their range, and for each range (__r) the rows before it."""
    dealt = with_range(df, order, "__range")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return dealt, dealt.groupBy("__range").agg(F.count("*").alias("__n")).select(F.col("__range").alias("__r"), before.alias("__before"))


def with_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """A global row number (long, from 1) in the given order (nulls first), without putting all rows in one task.

    Rows are dealt to ranges (`with_range`), ranges are counted (one row each), and rows are numbered within theirs.
    """
    dealt, counts = _counted(df, order)
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    joined = dealt.withColumn("__local", local).join(F.broadcast(counts), F.col("__range") == F.col("__r"))
    return joined.withColumn(out, (F.col("__before") + F.col("__local")).cast("long")).drop("__range", "__local", "__r", "__before")


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], part: str | None = None) -> DataFrame:
    """Adds, under the given names, sums over the rows of a group up to each row (nulls first), however large a group is.

    Groups of up to LARGE_GROUP rows are one window each. Larger ones are cut into ranges of the order: a range's own
    running sums end in its totals, which are added up over the group's ranges (one row each) and joined back. A column
    that cuts groups in the order already, `part`, spares the look at the groups' sizes.
    """
    packed = df.withColumns({f"__s_{name}": value for name, value in sums.items()})
    if part is not None:
        return _summed_parts(packed, group, part, order, list(sums)).select(*df.columns, *sums)
    large = packed.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > LARGE_GROUP).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)])
    if large.isEmpty():
        return _summed(packed, group, order, sums).select(*df.columns, *sums)
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    usual = _summed(packed.join(large, same, "left_anti"), group, order, sums)
    dealt = with_range(packed.join(large, same, "left_semi"), [*group, *order], "__range")
    return usual.select(*df.columns, *sums).unionByName(_summed_parts(dealt, group, "__range", order, list(sums)).select(*df.columns, *sums))


def _summed(packed: DataFrame, group: list[str], order: list[str], names: list[str] | dict, out: str = "{}") -> DataFrame:
    own = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return packed.withColumns({out.format(name): F.sum(f"__s_{name}").over(own) for name in names})


def _summed_parts(packed: DataFrame, group: list[str], part: str, order: list[str], names: list[str]) -> DataFrame:
    """Running sums of groups that come in parts; totals are read off the parts' own sums, so that both share one shuffle."""
    local = _summed(packed, [*group, part], order, names, "__l_{}")
    last = local.groupBy(*group, part).agg(*[F.max_by(F.struct(f"__l_{name}"), F.struct(*order)).alias(f"__p_{name}") for name in names])
    ahead = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, part]
    parts = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.sum(F.col(f"__p_{name}")[f"__l_{name}"]).over(ahead).alias(f"__b_{name}") for name in names])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # nothing but nulls so far is null, as in SQL
    total = lambda name: F.when(F.col(f"__b_{name}").isNull(), F.col(f"__l_{name}")).otherwise(F.col(f"__b_{name}") + F.coalesce(F.col(f"__l_{name}"), F.lit(0)))
    return local.join(parts, same).withColumns({name: total(name) for name in names})


def shuffle_buffer(df: DataFrame, seed: str, size: int = 1000) -> DataFrame:
    """Shuffles rows within their partitions as they pass, without moving any to another task.

    Stretches of `size` rows are mixed, and then once more stretches that lie across two of those, so a row moves by
    less than 2 * `size` places. The order depends on the seed, the partition and the rows' places in it.
    """
    if size < 1:
        raise ValueError("size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([*f"{seed}/{TaskContext.get().partitionId()}".encode()])

        def mixed(tables: Iterator[pa.Table], first: int) -> Iterator[pa.Table]:
            held, want = None, first
            for table in tables:
                held = table if held is None else pa.concat_tables([held, table])
                while held.num_rows >= want:
                    yield held.slice(0, want).take(pa.array(rng.permutation(want)))
                    held, want = held.slice(want), size
            if held is not None and held.num_rows:
                yield held.take(pa.array(rng.permutation(held.num_rows)))

        whole = (pa.Table.from_batches([b]) for b in batches if b.num_rows)
        for table in mixed(mixed(whole, size), max(1, size // 2)):
            yield from table.combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def sequence_keys(df: DataFrame, order: list[str], out: str = "key", width: int = 9) -> DataFrame:
    """Zero-padded running keys from 0."""
    return with_rank(df, order, "__rank").withColumn(out, F.lpad((F.col("__rank") - 1).cast("string"), width, "0")).drop("__rank")


def random_side(seed: str, key: Column, low: int, high: int) -> Column:
    """A multiple of 16 between 16*low and 16*high."""
    return 16 * (low + draw_int(seed, key, F.lit(high - low + 1)))


def crop_offset(seed: str, key: Column, size: Column, crop: Column) -> Column:
    """A start for a crop of the given length; 0 where it doesn't fit."""
    return F.when(size > crop, draw_int(seed, key, size - crop + 1)).otherwise(0)
