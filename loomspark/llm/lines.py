"""Line dedup by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import DOWN, UP, BASE, INVERSE, Words, checkpoint, chunks, dealt_anew, kept, mix, pack_columns, read_words, spans, text_as_bytes, text_back, with_row_key, written

#: A line within one word edit (insert, delete or substitute) of an earlier one is a duplicate, from MIN_WORDS words on;
#: that is a similarity of 0.8 at MIN_WORDS words, and more in longer lines (0.96 at 25 words). Shorter lines count as duplicates only when equal.
MIN_WORDS = 5
#: Bytes of text that a task parses at a time, and the size of the filter that is broadcast (8 MB).
PARSE_BYTES = 1 << 19
FILTER_BITS = 1 << 26
OTHER_BASE = 0xD1342543DE82EF95
KEY = ["__k1", "__k2"]
LINE = ["h1", "h2"]
PLACE = ["doc", *KEY, "line"]  # order of lines: id, then key of the row, then line number


@dataclass(frozen=True)
class Lines:
    """Lines that have words, of some texts: the text and the number in it, and the words from `start` to `end`."""

    words: Words
    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Lines:
        words = read_words(texts)
        breaks = np.nonzero(words.data == 10)[0]
        line = np.searchsorted(breaks, words.starts)
        opens = np.nonzero(np.diff(line, prepend=-1))[0]
        text = np.searchsorted(words.bounds, opens, "right")
        number = line[opens] - np.searchsorted(breaks, words.text_starts[text])
        return cls(words, text, number, opens, np.append(opens[1:], len(line)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit keys of the lines' words."""
        return tuple(spans(self.words.hashes, self.start, self.end, base).view(np.int64) for base in (BASE, OTHER_BASE))

    def halves(self) -> list[pa.Array]:
        """Hashes of the beginnings and ends of the two lengths that a line shares with lines one edit away; null where there is none."""
        n, out = self.end - self.start, []
        for number, m in enumerate((n // 2, (n - 1) // 2)):
            none = (n < MIN_WORDS - 1) | ((m == n // 2) | (n < MIN_WORDS) if number else np.zeros(len(n), bool))
            for side, (a, b) in enumerate(((self.start, self.start + m), (self.end - m, self.end))):
                found = mix(spans(self.words.hashes, a, b) ^ (2 * m + side).astype(np.uint64)).view(np.int64)
                out.append(pa.array(found, mask=none))
        return out


HALVES = ["a0", "b0", "a1", "b1"]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with words: its place, key, and halves."""
    for batch in chunks(batches, "__text", PARSE_BYTES):
        lines = Lines.of(batch.column(0).to_pylist())
        index = pa.array(lines.text)
        yield pa.RecordBatch.from_arrays([*[batch.column(i).take(index) for i in (1, 2, 3)], pa.array(lines.number), *map(pa.array, lines.keys()), *lines.halves()], names=[*PLACE, *LINE, *HALVES])


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A fixed FILTER_BITS bits, one set for each key. Past its size it lets more through, never less."""
    at = F.col("h1").bitwiseAND(FILTER_BITS - 1)
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(h1 & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = rows.toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return bits


def _passes(bits: np.ndarray, h1: np.ndarray) -> np.ndarray:
    at = h1 & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (h1 & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All deletion variants of each line as (hash, position deleted); position -1 stands for the whole line."""
    inverse = np.uint64(INVERSE)
    for batch in chunks(batches, "words", 1 << 17):
        words = read_words(batch.column(batch.schema.get_field_index("words")).to_pylist())
        n = np.diff(words.bounds, prepend=0)
        first = words.bounds - n
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * UP.upto(len(words.hashes)), dtype=np.uint64)])
        line = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words.hashes))
        down = DOWN.upto(len(words.hashes) + 1)
        last = words.bounds[line]
        without = ((sums[at] - sums[first[line]]) + (sums[last] - sums[at + 1]) * inverse) * down[first[line]]
        whole = (sums[words.bounds] - sums[first]) * down[first]
        index = pa.array(np.concatenate([line, np.arange(len(n))]))
        variant = mix(np.concatenate([without + (n[line] - 1).astype(np.uint64), whole + n.astype(np.uint64)])).view(np.int64)
        position = np.concatenate([at - first[line], np.full(len(n), -1)])
        yield pa.RecordBatch.from_arrays([pa.array(variant), pa.array(position), batch.column(0).take(index)], names=["variant", "position", "rank"])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one_edit(a.split(), b.split()) and max(a.count(b" "), b.count(b" ")) + 1 >= MIN_WORDS for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield batch.filter(pa.array(good, pa.bool_())).select(LINE)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_text") -> DataFrame:
    """Adds n_lines, n_removed (long) and `out` (the text without its duplicate lines) to every document.

    Lines end at \\n and are compared by their words. A line is removed if an earlier line, of this document or
    one of smaller id, has the same words, or, with MIN_WORDS words or more in the longer of the two, is one word
    edit away; whether that earlier line stays itself doesn't matter. Of rows with one id the row key decides;
    rows alike in id and text count as one and lose the same lines. A null id counts as the smallest. Lines
    without words stay. Null text counts as empty. An empty table gives no rows; other columns pass through.

    Equal lines fold into one first, so a frequent line costs one row from then on. Two lines one edit apart
    share their first or their last half; only lines whose half some other line has go on to emit variants.
    Lines that agree without their word at one position are pairwise one edit apart, so each such group needs
    only its earliest, and no pairs within groups are made. The texts of candidate pairs are compared in the end.
    """
    docs, unpack = pack_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = text_as_bytes(docs, text_col)
    names = source.columns
    source = with_row_key(source, id_col).withColumn("__doc", F.col(f"`{id_col}`"))
    doc_type = source.schema["__doc"].dataType.simpleString()
    place_type = f"doc {doc_type}, __k1 long, __k2 long, line long"

    lines = kept(source.select("__text", "__doc", *KEY).mapInArrow(_line_rows, f"{place_type}, " + ", ".join(f"{c} long" for c in LINE + HALVES)))
    distinct = lines.groupBy(*LINE).agg(*[F.min(c).alias(c) for c in HALVES])
    halves = distinct.select(F.explode(F.array_compact(F.array(*HALVES))).alias("half"), "h1")
    common = dealt_anew(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"), {"half": "__half"})
    shared = checkpoint(halves.join(common, halves["half"] == common["__half"]).select("h1").distinct())
    bits = spark.sparkContext.broadcast(_filter_of(shared))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", PARSE_BYTES):
            found = Lines.of(batch.column(0).to_pylist())
            h1, h2 = found.keys()
            at = np.nonzero(_passes(bits.value, h1))[0]
            data = found.words.data.tobytes()
            begin, end = found.words.starts[found.start[at]].tolist(), found.words.ends[found.end[at] - 1].tolist()
            texts = [b" ".join(data[a:b].split()) for a, b in zip(begin, end)]
            index = pa.array(found.text[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(index) for i in (1, 2, 3)], pa.array(found.number[at]), pa.array(h1[at]), pa.array(h2[at]), pa.array(texts, pa.binary())], names=[*PLACE, *LINE, "words"])

    # folded before the join, so that a frequent line brings one row from each task
    texts = source.select("__text", "__doc", *KEY).mapInArrow(candidates, f"{place_type}, h1 long, h2 long, words binary")
    texts = texts.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("p"), F.first("words").alias("words")).join(shared, "h1", "left_semi")
    # ranks follow the order of places: ranges of places, numbered, and rows numbered within them
    texts = written(texts.repartitionByRange(spread, "p").sortWithinPartitions("p").select(F.monotonically_increasing_id().alias("rank"), *LINE, "words"))

    variants = texts.select("rank", "words").mapInArrow(_variants, "variant long, position long, rank long")
    deleted, whole = variants.where("position >= 0"), variants.where("position < 0").select(F.col("variant").alias("v"), F.col("rank").alias("other"))
    earliest = deleted.groupBy("variant", "position").agg(F.min("rank").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    earliest = dealt_anew(earliest, {"variant": "v", "position": "at"})
    substituted = deleted.join(earliest, (F.col("variant") == F.col("v")) & (F.col("position") == F.col("at"))).select("rank", "other")
    inserted = deleted.join(whole, F.col("variant") == F.col("v")).select(F.greatest("rank", "other").alias("rank"), F.least("rank", "other").alias("other"))
    pairs = substituted.unionByName(inserted).where("rank > other").distinct()
    words = texts.select(F.col("rank").alias("t"), "words", *LINE)
    near = pairs.join(words, pairs["rank"] == words["t"]).select("other", *LINE, F.col("words").alias("a"))
    near = near.join(words.drop(*LINE), near["other"] == words["t"]).select("a", F.col("words").alias("b"), *LINE)
    near = near.mapInArrow(_verified, "h1 long, h2 long").distinct().withColumn("near", F.lit(True))

    first = lines.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"))
    ruled = first.join(near, LINE, "left").where("n > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    ruled = dealt_anew(ruled, {"h1": "g1", "h2": "g2"})
    gone = lines.join(ruled, (lines["h1"] == ruled["g1"]) & (lines["h2"] == ruled["g2"])).where(F.col("near") | (F.struct(*PLACE) > F.col("first"))).select(F.col("__k1").alias("__j1"), F.col("__k2").alias("__j2"), "line")
    gone = gone.groupBy("__j1", "__j2").agg(F.collect_set("line").alias("__lines"))  # of one document
    joined = source.join(gone, (source["__k1"] == gone["__j1"]) & (source["__k2"] == gone["__j2"]), "left")
    schema = source.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias(out)).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name.startswith("__")}
            rows = []
            for text, dropped in zip(column["__text"].to_pylist(), column["__lines"].to_pylist()):
                own = text.split(b"\n")
                dropped = set(dropped or ())
                rows.append((len(own), len(dropped), b"\n".join(x for i, x in enumerate(own) if i not in dropped).decode()))
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *made], names=[*names, "n_lines", "n_removed", out])

    return unpack(text_back(joined.mapInArrow(remove, schema), text_col, *docs.columns, "n_lines", "n_removed", out))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
