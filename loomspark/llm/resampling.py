"""Importance resampling towards a target distribution of hashed n-grams; long texts are cut into overlapping chunks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, small_batches, with_row_key, written
from loomspark.operators.sampling import with_rank

#: Words of the longest feature, buckets that features are hashed to, seed of the draw.
LONGEST = 1
BUCKETS = 10000
SEED = "2024"
#: Fewest words of a document that can be drawn, and the share of those that is (percent).
MIN_WORDS = 20
PERCENT = 10
#: Texts of more bytes are cut into chunks of about this size, which are dealt to tasks of their own.
CHUNK = 1 << 16
#: Features whose bucket a Python worker remembers.
REMEMBERED = 1 << 19

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


def cut(text: bytes, carry: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a lower-cased text, cut between words: (bytes, how many of them the chunk owns).

    Every chunk but the last goes on for `carry` words that the next one owns. A chunk owns the features that start in
    its own bytes, so that each start belongs to one chunk.
    """
    at = 0
    while at + size < len(text) and (border := BETWEEN.search(text, at + size)):
        end = last = border.start()
        for word in islice(WORD.finditer(text, end), carry):
            last = word.end()
        yield text[at:last], end - at
        at = end
    yield text[at:], len(text) - at


class Buckets(dict):
    """Buckets of features by crc32, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found

    def of(self, chunk: bytes, own: int, longest: int) -> tuple[int, np.ndarray]:
        """Number of words that the chunk owns, and the buckets of the features that start there."""
        words = WORD.findall(chunk)
        owned = len(words) if own == len(chunk) else len(WORD.findall(chunk[:own]))
        runs = [words[:owned]]
        for k in range(2, longest + 1):
            runs.append([b" ".join(words[i : i + k]) for i in range(min(owned, len(words) - k + 1))])
        return owned, np.concatenate([np.fromiter(map(self.__getitem__, r), dtype=np.int64, count=len(r)) for r in runs])


def featured(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """Rows (__id, __k1, __k2, __part, __words, __buckets) of chunks from rows (__id, __text as bytes).

    A text of at most `size` bytes is one chunk, counted where it is read, with null keys. Longer ones are cut, and their
    chunks are dealt evenly to tasks, whatever text they are of. __buckets holds the features' buckets as bytes.
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in chunks(batches, "__text"):
            own = batch.column("__own").to_pylist()
            found = [known.of(t.lower(), n, longest) for t, n in zip(batch.column("__text").to_pylist(), own)]
            columns = [batch.column(c) for c in ("__id", "__k1", "__k2", "__part")]
            counted = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *counted], names=["__id", "__k1", "__k2", "__part", "__words", "__buckets"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            for i, text in enumerate(batch.column("__text").to_pylist()):
                keys = [batch.column(c).slice(i, 1) for c in ("__id", "__k1", "__k2")]
                for part, (piece, own) in enumerate(cut(text.lower(), longest - 1, size)):
                    values = [pa.array([piece], pa.binary()), pa.array([part], pa.int64()), pa.array([own], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*keys, *values], names=["__id", "__k1", "__k2", "__text", "__part", "__own"])

    long, none, zero = F.octet_length("__text") > size, F.lit(None).cast("long"), F.lit(0).cast("long")
    key = f"__id {texts.schema['__id'].dataType.simpleString()}, __k1 long, __k2 long"
    short = texts.where(~long).select("__id", none.alias("__k1"), none.alias("__k2"), "__text", zero.alias("__part"), F.octet_length("__text").cast("long").alias("__own"))
    cut_up = with_row_key(texts.where(long), "__id").mapInArrow(pieces, f"{key}, __text binary, __part long, __own long").hint("rebalance")
    schema = f"{key}, __part long, __words long, __buckets binary"
    return short.mapInArrow(count, schema).unionByName(cut_up.mapInArrow(count, schema))


def totals(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) of all chunks; every task adds up its own."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                n += np.bincount(np.frombuffer(value.as_buffer(), dtype=kind), minlength=buckets)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return counted.select("__buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain in thousandths: the log of its share in the target by its share in the raw rows, each count plus one.

    As many numbers as there are buckets come to the driver, whatever the input.
    """
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    counts = raw.sparkSession.range(buckets).join(found, F.col("id") == F.col("bucket"), "left").select("id", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    real = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log((real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))))
    return np.array([r["gain"] for r in counts.crossJoin(F.broadcast(sums)).select("id", gain.alias("gain")).orderBy("id").collect()], dtype=np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows (__id, words, n_features, weight), one per document: sums over its chunks."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    names = ["__id", "__k1", "__k2", "__part", "__words"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(value.as_buffer(), dtype=kind) for value in batch.column("__buckets")]
            sums = [pa.array([len(b) for b in found], pa.int64()), pa.array([int(gain[b].sum()) for b in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *sums], names=[*names, "n_features", "weight"])

    key = f"__id {counted.schema['__id'].dataType.simpleString()}, __k1 long, __k2 long, __part long, __words long"
    rows = counted.mapInArrow(weigh, f"{key}, n_features long, weight long")
    whole = rows.where("__k1 IS NULL").select("__id", F.col("__words").alias("words"), "n_features", "weight")
    # repeated rows share their key: each of them has a first chunk and an equal part of the sums
    copies = F.sum(F.when(F.col("__part") == 0, 1).otherwise(0)).alias("copies")
    cut_up = rows.where("__k1 IS NOT NULL").groupBy("__id", "__k1", "__k2").agg(copies, F.sum("__words").alias("words"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    cut_up = cut_up.select("__id", *[F.expr(f"{c} div copies").alias(c) for c in ("words", "n_features", "weight")], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return whole.unionByName(cut_up.drop("copy"))


def gumbel(seed: str, key: Column) -> Column:
    """A Gumbel number in thousandths from seed and key, so that the highest weight plus number is a weighted draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank (long; null for rows that aren't drawn).

    Features are runs of 1 to `longest` words, counted over whole texts; weight is the sum of their buckets' gains,
    score adds the row's Gumbel number. Of the rows with `min_words` words or more, `percent` percent (rounded down)
    with the highest scores are drawn, ties to the smaller id, a null id first. Null texts have no words. Repeated rows
    come out, count and are drawn as often. Other columns are ignored; an empty table gives no rows, and an empty
    target leaves every bucket its smoothed share.
    """
    texts = lambda df, name, column: small_batches(df).select(name.alias("__id"), F.coalesce(F.col(column), F.lit("")).cast("binary").alias("__text"))
    counted = written(featured(texts(docs, F.col(id_col), text_col), longest, buckets, chunk))
    wanted = featured(texts(target, F.lit(0), target_text_col), longest, buckets, chunk)
    rows = weighed(counted, gains(totals(counted, buckets), totals(wanted, buckets), buckets))
    scored = written(rows.withColumn("score", F.col("weight") + gumbel(seed, F.col("__id"))))
    able = scored.where(F.col("words") >= min_words)
    drawn = able.agg(F.floor(percent * F.count("*") / 100).alias("__drawn"))  # one row
    ranked = with_rank(able.withColumn("__down", -F.col("score")), ["__down", "__id"], "rank").drop("__down")
    ranked = ranked.crossJoin(F.broadcast(drawn)).withColumn("rank", F.when(F.col("rank") <= F.col("__drawn"), F.col("rank"))).drop("__drawn")
    rest = scored.where(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("__id").alias(id_col), F.col("words").alias("n_words"), "n_features", "weight", "score", "rank")


def op12_chunked_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs, target).drop("n_words")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), raw AS (
    SELECT r, unnest(words) AS w FROM docs
), target AS (
    SELECT unnest({_WORDS}) AS w FROM benchmark
), spelled AS (
    SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM raw UNION SELECT w FROM target)
), bytes AS (
    SELECT w, flatten(list_transform(range(0, len(x) // 2), lambda i: [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM spelled
), hashed AS (
    SELECT w, xor(list_reduce(list_prepend(4294967295, steps), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % {BUCKETS} AS bucket FROM bytes
), counts AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t
    FROM (SELECT bucket, 1 AS s, 0 AS t FROM raw JOIN hashed USING (w) UNION ALL SELECT bucket, 0, 1 FROM target JOIN hashed USING (w)) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {BUCKETS}::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {BUCKETS}::DOUBLE)))) AS BIGINT) AS gain FROM counts
), weights AS (
    SELECT r, count(*) AS n_features, sum(gain) AS weight FROM raw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score,
           coalesce(n_features, 0) >= {MIN_WORDS} AS able
    FROM docs LEFT JOIN weights USING (r)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, sum(CAST(able AS INT)) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
