"""Streaming forms: endless resampling, resumable scoring, rolling balance and event windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomspark.operators.balance import CHOSEN, REMEMBERED, Ring, chosen
from loomspark.operators.sampling import with_rank
from loomspark.session import scratch


class _Blocks(SimpleDataSourceStreamReader):
    """Numbers that never end; offsets are the numbers, so that a restart goes on where it was and replays the same ones."""

    def __init__(self, blocks: int):
        self.blocks = blocks

    def initialOffset(self) -> dict:
        return {"block": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"block": start["block"] + self.blocks}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(i,) for i in range(start["block"], end["block"])])


class BlockSource(DataSource):
    """Format `blocks`: an endless stream of 0, 1, 2, ...; option blocks: how many a micro-batch."""

    @classmethod
    def name(cls):
        return "blocks"

    def schema(self):
        return "block long"

    def simpleStreamReader(self, schema):
        return _Blocks(int(self.options.get("blocks", 1)))


def drawn_number(seed: str, draw: Column, n: int) -> Column:
    """Which of n rows the draw falls on: a hash of seed and draw alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), draw.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(max(n, 1)).cast("long"))


def _numbered(spark: SparkSession, table: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Keys with their number in key order from 0, kept in a file, and how many they are."""
    path = scratch(spark)
    with_rank(table.select(key), [key], "__rank").select(key, (F.col("__rank") - 1).alias("__number")).write.parquet(path)
    kept = spark.read.parquet(path)
    return kept, kept.count()


def resampled(spark: SparkSession, table: DataFrame, key: str, size: int = 1000, seed: str = "0", blocks: int = 1) -> DataFrame:
    """An endless stream (draw, key) of draws with replacement from a table of keys, such as shards: `blocks` times `size` a micro-batch.

    The source gives block numbers alone; draws are made from them by the executors. A draw depends on the seed and its
    number, so that a restarted query replays the draws it had not finished and then goes on. Keys are numbered once.
    """
    spark.dataSource.register(BlockSource)
    numbered, n = _numbered(spark, table, key)
    ticks = spark.readStream.format("blocks").option("blocks", str(blocks)).load()
    draws = ticks.select(F.explode(F.sequence(F.col("block") * size, F.col("block") * size + (size - 1))).alias("draw"))
    return draws.withColumn("__number", drawn_number(seed, F.col("draw"), n)).join(numbered, "__number").select("draw", key)


def resampled_batch(spark: SparkSession, table: DataFrame, key: str, draws: int, seed: str = "0", first: int = 0) -> DataFrame:
    """The bounded form: the stream's draws from number `first` on."""
    numbered, n = _numbered(spark, table, key)
    rows = spark.range(first, first + draws).select(F.col("id").alias("draw"))
    return rows.withColumn("__number", drawn_number(seed, F.col("draw"), n)).join(numbered, "__number").select("draw", key)


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams get a watermark, which needs times with a zone; tables stay as they are."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def event_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind; works on streams (with a watermark) and tables."""
    source = _watermarked(events, ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return source.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    source = _watermarked(events, ts, late)
    return source.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


class Once(StatefulProcessor):
    """Lets a key's first row through, unless the key was there from the beginning."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


#: Columns of the scored table that tell which run and micro-batch a row came with.
RUN, BATCH = "_run", "_batch"


def scored(spark: SparkSession, path: str) -> DataFrame:
    """What score_into has written."""
    return spark.read.parquet(path).drop(RUN, BATCH)


def score_into(stream: DataFrame, score, path: str, checkpoint: str, key: str):
    """Scores what a stream brings and adds it to a table, each key once, across crashes and runs.

    Keys that have come are state, seeded once, in the first micro-batch of a new checkpoint, with those that the
    table has; no later one reads the table. A micro-batch writes a folder of its own, named by checkpoint and
    number, so that one that is run again replaces what it had written. Needs the RocksDB state store.
    """
    spark = stream.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as problem:  # noqa: BLE001  nothing has been written yet
        if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
            raise
        done = spark.createDataFrame([], T.StructType([stream.schema[key]]))
    new = stream.groupBy(key).transformWithState(Once(), outputStructType=stream.schema, outputMode="Append", timeMode="None", initialState=done.distinct().groupBy(key))

    def batch(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH}={number}")

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


class _Remembering(StatefulProcessor):
    """Keeps a group's ring as map state: a micro-batch writes the slots and counts that it changes."""

    size = REMEMBERED

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "kind string")
        self.counts = handle.getMapState("counts", "kind string", "n long")
        self.total = handle.getValueState("total", "total long")

    def ring(self) -> Ring:
        return Ring(self.size, self.slots, self.counts, self.total.get()[0] if self.total.exists() else 0)

    def keep(self, ring: Ring) -> None:
        ring.store()
        self.total.update((ring.total,))

    def close(self) -> None:
        pass


class RollingBalance(_Remembering):
    """Counts of kinds among the last `size` items of a group; each item comes out with the share of its kind before it."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring, out = self.ring(), []
        for frame in rows:
            for kind in frame["kind"]:
                out.append((key[0], kind, ring.share(kind)))
                ring.push(kind)
        self.keep(ring)
        yield pd.DataFrame(out, columns=["group", "kind", "share"])


class AdaptiveBalance(_Remembering):
    """Chooses kinds for each request by what the group was given lately (see operators.balance)."""

    def __init__(self, kinds: list[str], n: int = CHOSEN, size: int = REMEMBERED, seed: str = "0"):
        self.kinds, self.n, self.size, self.seed = kinds, n, size, seed

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ring = self.ring()
        for request in sorted(r["request"] for r in rows):  # a micro-batch comes in any order
            yield Row(group=key[0], request=request, chosen=chosen(ring, f"{self.seed}/{key[0]}/{request}", self.kinds, self.n))
        self.keep(ring)


def balanced(stream: DataFrame, group: str = "group") -> DataFrame:
    """Applies RollingBalance to a stream with columns group and kind."""
    return stream.groupBy(group).transformWithStateInPandas(RollingBalance(), outputStructType="group string, kind string, share double", outputMode="Append", timeMode="None")


def balanced_requests(stream: DataFrame, kinds: list[str], n: int = CHOSEN, size: int = REMEMBERED, seed: str = "0") -> DataFrame:
    """Applies AdaptiveBalance to a stream with columns group (string) and request (long); the state is at most `size` kinds a group."""
    processor = AdaptiveBalance(kinds, n, size, seed)
    return stream.groupBy("group").transformWithState(processor, outputStructType="group string, request long, chosen array<string>", outputMode="Append", timeMode="None")
