"""Members of tar shards by key: an index of their places, reads of their bytes alone, and a cache of what was read."""

from __future__ import annotations

import contextlib
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.shards import BATCH_BYTES, INDEXES, split_name
from loomspark.sources.stores import file_system

PLACES = "key string, ext string, shard string, offset long, size long"
#: Bytes of a shard whose members one task fetches: a large shard is dealt to several.
REACH = 256 << 20
#: Folders that keys are dealt to in an index or cache by key.
BUCKETS = 64


def bucket(key: str = "key", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def written_index(spark: SparkSession, path: str) -> DataFrame:
    """Places (key, ext, shard, offset, size) of all members that write_shards has committed to a folder."""
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.parquet$", 1)
    return spark.read.parquet(f"{path}/{INDEXES}").select("key", "ext", F.concat(F.lit(f"{path}/"), number, F.lit(".tar")).alias("shard"), "offset", "size")


def indexed(spark: SparkSession, shards: list[str]) -> DataFrame:
    """Places of the members of any shards, read from their headers; a shard that can't be read to its end lacks what follows.

    A task reads several shards where there are many. Every use reads all headers again: see write_by_key for keeping them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                rows = []
                fs, path = file_system(shard)
                with contextlib.suppress(tarfile.TarError, EOFError), fs.open_input_file(path) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                    rows += [(*split_name(m.name), shard, m.offset_data, m.size) for m in tar if m.isfile()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "ext", "shard", "offset", "size"])

    tasks = min(len(shards), int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.createDataFrame([(s,) for s in shards], "shard string").repartition(max(1, tasks))
    return listed.mapInArrow(read, PLACES)


def write_by_key(places: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """An index in folders by key, sorted by key within: a lookup opens the folders of its keys alone."""
    places.withColumn("bucket", bucket("key", buckets)).repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").mode("overwrite").parquet(path)


def by_key(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Places of the wanted keys from an index that write_by_key has left; folders that no key belongs to aren't opened."""
    keys = wanted.select("key").distinct().withColumn("bucket", bucket("key", buckets))
    folders = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most as many as there are buckets
    return spark.read.parquet(path).where(F.col("bucket").isin(folders)).join(keys, ["bucket", "key"], "left_semi").drop("bucket")


def read_places(batches: Iterator[pa.RecordBatch], open_file: Callable[[str], object] | None = None) -> Iterator[pa.RecordBatch]:
    """Adds payloads to rows (key, ext, shard, offset, size), sorted by shard: nothing else of a shard is read."""

    def opened(shard: str):
        fs, path = file_system(shard)
        return fs.open_input_file(path)

    shard, file, names = None, None, ["key", "ext", "shard", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
    try:
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if file is not None:
                        file.close()
                    shard, file = row["shard"], (open_file or opened)(row["shard"])
                held.append((row["key"], row["ext"], shard, file.read_at(row["size"], row["offset"])))
                size += row["size"]
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
    finally:
        if file is not None:
            file.close()


def fetched(places: DataFrame) -> DataFrame:
    """Rows (key, ext, shard, payload) of the given places; bytes read are those of the members."""
    dealt = places.select("key", "ext", "shard", "offset", "size").repartition(F.col("shard"), F.floor(F.col("offset") / REACH))
    return dealt.sortWithinPartitions("shard", "offset").mapInArrow(read_places, "key string, ext string, shard string, payload binary")


def cached(spark: SparkSession, places: DataFrame, cache: str, buckets: int = BUCKETS) -> DataFrame:
    """The same rows, from the cache as far as it has them; what it lacks is fetched once and added.

    The cache is a Parquet table in folders by key. An addition is one append, so that a failed one leaves no rows;
    two at a time may add a member twice, which comes out once.
    """
    wanted = places.withColumn("bucket", bucket("key", buckets))
    member = ["bucket", "key", "ext"]

    def held() -> DataFrame | None:
        try:
            return spark.read.parquet(cache)
        except Exception as problem:  # noqa: BLE001  nothing is cached yet
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
            return None

    there = held()
    missing = wanted if there is None else wanted.join(there.select(*member), member, "left_anti")
    if not missing.isEmpty():
        fetched(missing).withColumn("bucket", bucket("key", buckets)).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(cache)
        there = held()
    if there is None:
        return fetched(places)
    return there.join(wanted.select(*member).distinct(), member, "left_semi").dropDuplicates(["key", "ext"]).select("key", "ext", "shard", "payload")
