"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into words at a time; bounds its memory whatever the batch.
CHUNK_BYTES = 2 << 20


def pack_columns(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Puts all columns but the used ones into one struct, so that no name of theirs can clash, and a function that takes them out.

    That function puts the input's columns back in their order, then what was added. An input column of the same
    name (in any case) as an added one gives way to it.
    """
    names, used = df.columns, tuple(dict.fromkeys(used))
    rest = [c for c in names if c not in used]
    packed = df.select(*[F.col(f"`{c}`") for c in used], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row")] if rest else []))

    def unpack(out: DataFrame) -> DataFrame:
        added = [c for c in out.columns if c not in used and c != "__row"]
        taken = {c.lower() for c in added}
        kept = [(F.col(f"`{c}`") if c in used else F.col("__row").getField(c).alias(c)) for c in names if c.lower() not in taken]
        return out.select(*kept, *[F.col(f"`{c}`") for c in added])

    return packed, unpack


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; a local session without one, as in tests, gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "loomspark-checkpoints"))


def small_batches(df: DataFrame) -> DataFrame:
    """Lets Arrow batches hold 8 MB instead of the default 64, which is what a task's two sides hold of a wide table of long texts."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so the rows outlive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt_anew(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Renames keys (old name to new) behind an expression, so that a join shuffles rows that were aggregated by them once more.

    With a shuffle of its own on both sides Spark can split a frequent key of the other side over tasks.
    """
    return df.select(*[F.col(k).bitwiseXOR(F.lit(1).cast("long")).bitwiseXOR(F.lit(1).cast("long")).alias(new) for k, new in keys.items()], *[c for c in df.columns if c not in keys])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices record batches so that `column` (binary) has about `limit` bytes in each; one longer value stands alone.

    At the end of a task what it has freed goes back to the system, for Python workers live on.
    """
    try:
        yield from _sliced(batches, column, limit)
    finally:
        release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        sizes = [0 if n is None else n for n in pc.binary_length(values).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def with_row_key(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds the 128-bit row key (__k1, __k2) of id and __text.

    The key comes from what a row says, so every run of a task gives it again; identical rows share it.
    """
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\u0000null"))
    return rows.select("*", F.xxhash64(name, "__text").alias("__k1"), F.xxhash64("__text", name, F.lit(1)).alias("__k2"))


def with_text_key(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the key (__k1, __k2) of a text in bytes: the first 128 bits of its SHA-256, so that texts of one key are the same text.

    Both halves are columns without nulls, so that inner and outer joins on them read the same shuffle.
    """
    half = lambda at: F.coalesce(F.conv(F.substring("__digest", at, 16), 16, -10).cast("long"), F.lit(0).cast("long"))
    keyed = rows.withColumn("__digest", F.sha2(text, 256))
    return keyed.select(*[F.col(f"`{c}`") for c in rows.columns], half(1).alias("__k1"), half(17).alias("__k2"))


def text_as_bytes(docs: DataFrame, text_col: str) -> DataFrame:
    """Puts __text (binary, null as empty) and __null in place of the text, so that a shuffle carries it once."""
    text = F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return small_batches(docs).select(*rest, text.isNull().alias("__null"), F.coalesce(text, F.lit("")).cast("binary").alias("__text"))


def text_back(rows: DataFrame, text_col: str, *columns: str) -> DataFrame:
    """Undoes text_as_bytes and selects columns."""
    return rows.withColumn(text_col, F.when(~F.col("__null"), F.col("__text").cast("string"))).select(*[F.col(f"`{c}`") for c in columns])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a 64-bit number, extended as longer sequences come."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


#: White space between words, and a random 64-bit number for each byte.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_BLOCK = 1 << 18
_LONG_WORD = 512
UP, DOWN = Powers(BASE), Powers(INVERSE)


@dataclass(frozen=True)
class Words:
    """Words of some texts, one text after the other: hashes, byte offsets in `data`, and the words before each text's end."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    text_starts: np.ndarray


def read_words(texts: list[bytes]) -> Words:
    """64-bit hashes of all words between ASCII white space, by arrays, without an object for each word.

    A word's hash is a polynomial over its bytes, taken from running sums of one block; words too long for that to
    be safe are hashed on their own.
    """
    whole = b"\n".join([*texts, b""])
    data = np.frombuffer(whole, dtype=np.uint8)
    space = _SPACE[data]
    change = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.nonzero(change == -1)[0], np.nonzero(change == 1)[0]
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(int(np.searchsorted(starts, base + _BLOCK)), at + 1)
        end = int(ends[to - 1])
        sums = np.empty(end - base + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[base:end]] * UP.upto(end - base), out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((sums[e] - sums[s]) * DOWN.upto(end - base)[s] + (e - s).astype(np.uint64))
        at = to
    for i in np.nonzero(ends - starts > _LONG_WORD)[0].tolist():
        hashes[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]])
    text_starts = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))])
    return Words(data, hashes, starts, ends, np.searchsorted(starts, text_starts[1:]), text_starts[:-1])


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of spans of words."""
    up, down = (UP, DOWN) if base == BASE else _powers(base)
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up.upto(len(hashes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down.upto(len(hashes) + 1)[starts] + (ends - starts).astype(np.uint64))


@cache
def _powers(base: int) -> tuple[Powers, Powers]:
    return Powers(base), Powers(pow(base, -1, 1 << 64))


def kept(df: DataFrame) -> DataFrame:
    """Keeps rows that come from one pass over the input on the executors' disks: computed once, whatever uses them.

    What is lost with an executor is computed again from the input, which is why rows must not depend on the run.
    The session's clearCache() frees the disks. No file is made, so nothing stays in the shared folder.
    """
    return df.persist(StorageLevel.DISK_ONLY)


#: Tables that `written` has left in the shared folder since `clean` last ran.
WRITTEN: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes the tables that `written` has left in the shared folder; for when the results that read them are saved."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while WRITTEN:
        path = hadoop.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Writes rows as Parquet to the shared folder and reads them again: computed once, whatever uses them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
