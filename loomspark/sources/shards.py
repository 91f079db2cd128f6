"""Tar shards as a data source: one partition a shard on reading, rolling shards on writing."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from loomspark.sources.stores import PARTS, CommitLog, file_system, opened

#: Bytes of members that go out together.
BATCH_BYTES = 4 << 20
INDEX = pa.schema([("key", pa.string()), ("ext", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
#: Folder of the shards' indexes.
INDEXES = "index"
MEMBERS = "shard string, key string, ext string, payload binary, error string"


def split_name(name: str) -> tuple[str, str]:
    """Key and extension: the file name is cut at its first dot, folders belong to the key."""
    folder, _, base = name.rpartition("/")
    stem, _, ext = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ext


@dataclass
class _Shard(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Shard(p) for p in self.paths] or [_Shard("")]

    def read(self, partition):
        path = partition.path
        if not path:
            return
        try:
            with opened(path) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                for member in tar:
                    if member.isfile():
                        key, ext = split_name(member.name)
                        yield path, key, ext, tar.extractfile(member).read(), None
        except (tarfile.TarError, OSError, EOFError) as problem:
            yield path, None, None, None, f"{type(problem).__name__}: {problem}"


class _FilteredReader(_Reader):
    """For sessions that push filters down to Python sources."""

    def pushFilters(self, filters):
        """Shards that equality on `shard` rules out are never opened."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("shard",):
                self.paths = [p for p in self.paths if p == f.value]
            elif isinstance(f, In) and f.attribute == ("shard",):
                self.paths = [p for p in self.paths if p in f.value]
            else:
                yield f


class _Committed(WriterCommitMessage):
    def __init__(self, groups: list[dict[str, str]]):
        self.groups = groups


class _Writer(DataSourceWriter):
    """Rows (key, ext, payload) of one partition in order; a new shard begins at maxcount keys or maxsize bytes.

    Beside each shard goes its index: a Parquet file with the place of each member's payload.
    """

    def __init__(self, root: str, maxcount: int, maxsize: int, token: str, writer: str | None, batch: int, replace: bool):
        self.root, self.maxcount, self.maxsize, self.token = root, maxcount, maxsize, token
        self.writer, self.batch, self.replace = writer, batch, replace

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = file_system(self.root)
        # a name for each attempt: those of lost or repeated tasks are in no message, so no commit names them
        own = f"{PARTS}/{self.token}/{context.partitionId():05d}-{context.attemptNumber()}"
        fs.create_dir(f"{root}/{own}", recursive=True)
        groups, tar, stream, index, count, size, last = [], None, None, [], 0, 0, None

        def close() -> None:
            if tar:
                tar.close()
                stream.close()
                with fs.open_output_stream(f"{root}/{groups[-1]}.parquet", compression=None) as out:
                    pq.write_table(pa.Table.from_pylist(index, INDEX), out)

        for row in rows:
            new = row["key"] != last
            if tar is None or new and (count >= self.maxcount or size >= self.maxsize):
                close()
                groups.append(f"{own}/{len(groups):05d}")
                stream = fs.open_output_stream(f"{root}/{groups[-1]}.tar", compression=None)
                tar, index, count, size = tarfile.open(fileobj=stream, mode="w|"), [], 0, 0
            count += new
            last = row["key"]
            info = tarfile.TarInfo(f"{row['key']}.{row['ext']}")
            info.size = len(row["payload"])
            size += info.size
            tar.addfile(info, io.BytesIO(bytes(row["payload"])))
            index.append({"key": row["key"], "ext": row["ext"], "offset": tar.offset - -(-info.size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE, "size": info.size})
        close()
        return _Committed([{f"{g}.tar": "{number}.tar", f"{g}.parquet": INDEXES + "/{number}.parquet"} for g in groups])

    def commit(self, messages):
        log = CommitLog(self.root)
        groups = [g for m in messages if m for g in m.groups]
        if groups or self.replace:
            log.commit(groups, self.writer, self.batch, self.replace)
        log.discard(self.token)

    def abort(self, messages):
        CommitLog(self.root).discard(self.token)


class ShardSource(DataSource):
    """Format `shards`. Option paths: a JSON list (see paths.listed). For writing: path, maxcount, maxsize, writer, batch.

    Shards are streamed from and to any store that Arrow's file systems reach, whatever their size; a local path
    must be a folder that all executors share.
    """

    @classmethod
    def name(cls):
        return "shards"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return (_FilteredReader if self.options.get("filtered") == "true" else _Reader)(json.loads(self.options["paths"]))

    def writer(self, schema, overwrite):
        sizes = int(self.options.get("maxcount", 5000)), int(float(self.options.get("maxsize", 6e9)))
        return _Writer(self.options["path"], *sizes, uuid.uuid4().hex, self.options.get("writer"), int(self.options.get("batch", 0)), overwrite)


def read_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a member; a shard that can't be read to its end adds a row with `error` alone.

    Where the session has spark.sql.python.filterPushdown.enabled, shards that a filter on `shard` rules out aren't opened.
    """
    spark.dataSource.register(ShardSource)
    filtered = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("shards").option("paths", json.dumps(paths)).option("filtered", filtered).load()


def read_remote_members(spark: SparkSession, patterns: list[str] | str) -> DataFrame:
    """The same rows for shards in a store that Spark alone reads (see read_members for the others): files come as binary rows, so each has 2 GB at most."""
    listed = spark.read.format("binaryFile").load(patterns).select("path", "content")

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                try:
                    with tarfile.open(fileobj=pa.BufferReader(content.as_buffer()), mode="r|") as tar:
                        for member in tar:
                            if member.isfile():
                                held.append((path, *split_name(member.name), tar.extractfile(member).read(), None))
                                size += member.size
                                if size >= BATCH_BYTES:
                                    yield _members(held)
                                    held, size = [], 0
                except (tarfile.TarError, OSError, EOFError) as problem:
                    held.append((path, None, None, None, f"{type(problem).__name__}: {problem}"))
                if held:
                    yield _members(held)

    return listed.mapInArrow(unpack, MEMBERS)


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "key", "ext", "payload", "error"])


def samples(members: DataFrame, extensions: list[str]) -> DataFrame:
    """One row a sample: shard, key, and a binary column m["ext"] for each extension, in struct `m`."""
    good = members.where("error IS NULL")
    picked = [F.first(F.when(F.col("ext") == e, F.col("payload")), ignorenulls=True).alias(e) for e in extensions]
    wide = good.where(F.col("ext").isin(extensions)).groupBy("shard", "key").agg(*picked)
    return wide.select("shard", "key", F.struct(*[F.col(f"`{e}`") for e in extensions]).alias("m"))


def health(members: DataFrame) -> DataFrame:
    """Shards with their members and error, if any."""
    return members.groupBy("shard").agg(F.count("key").alias("members"), F.max("error").alias("error"))


def image_keys(m: Column, names: list[str]) -> Column:
    """Source image under whichever convention the producer used: with an index, or with one dot less."""
    known = [m[n] for n in ("1.0.jpg", ".1.0.jpg", "1.jpg", ".1.jpg") if n in names]
    return F.coalesce(*known)


def write_shards(members: DataFrame, path: str, maxcount: int = 5000, maxsize: float = 6e9, mode: str = "append", writer: str | None = None, batch: int = 0) -> None:
    """Writes (key, ext, payload) rows as numbered tar shards; a key's members stay together.

    Shards appear by whole writes (see stores.CommitLog), and numbers go on from those that are there; mode "overwrite"
    puts the new shards in the place of all others. A batch of a named writer that has been written once is left out,
    so that a job that runs again adds nothing.
    """
    spark = members.sparkSession
    spark.dataSource.register(ShardSource)
    rows = members.select(F.lit(None).cast("string").alias("shard"), "key", "ext", "payload", F.lit(None).cast("string").alias("error"))
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    out = rows.repartition("key").sortWithinPartitions("key", "ext").write.format("shards").mode(mode).option("maxcount", str(maxcount)).option("maxsize", str(maxsize))
    if writer is not None:
        out = out.option("writer", writer).option("batch", str(batch))
    out.save(path)


def stream_shards(stream: DataFrame, path: str, checkpoint: str, maxcount: int = 5000, maxsize: float = 6e9):
    """A stream's rows as shards, each micro-batch one commit, known by the checkpoint's location: a replayed one adds nothing.

    Members of a key that come in different micro-batches stand in different shards.
    """
    writer = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(rows: DataFrame, batch: int) -> None:
        write_shards(rows, path, maxcount, maxsize, writer=writer, batch=batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
