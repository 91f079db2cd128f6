"""Hard-negative mining with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import release_memory, written

#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)
#: Cells of a dimension (a byte), vectors of a block of the file, and anchors that are searched for at a time.
CELLS = 256
BLOCK = 4096
ANCHORS = 256
#: Scores stay below this, so that a percentage of one fits a long.
LARGEST = 2.0**56

#: A block of the file, or of anchors: vectors sorted by label, then id. cells holds a byte for each dimension and vector, low and high
#: the least and greatest code of each cell, wanted the scores of each anchor's positives (-1 for none).
BLOCK_SCHEMA = "ids binary, labels binary, dims int, codes binary, width int, anchor binary, cells binary, low binary, high binary, wanted binary"
FIELDS = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """Rows (id, label, anchor, vector) with an id, a label and a finite vector; one for each id, the smallest by label and vector."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.label", "r.anchor", "r.vector")


def codes_of(vectors: list[np.ndarray]) -> np.ndarray:
    """Codes of vectors as a matrix; what a shorter vector lacks is zero."""
    dims = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out = np.floor(SCALE * out)
    if len(out) and out.size and np.abs(out).max() >= LARGEST:
        raise ValueError("a vector's components are too large for scores in a long")
    return out.astype(np.int64)


def approximate(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (dims by vectors) with the least and greatest code in each (dims by CELLS).

    Cells hold about equally many vectors; their bounds are those of the codes in them, so no code lies outside.
    """
    n, dims = codes.shape
    order = np.sort(codes, axis=0)
    borders = order[np.arange(1, CELLS) * n // CELLS]
    cell = np.empty((dims, n), dtype=np.uint8)
    low, high = np.zeros((dims, CELLS), dtype=np.int64), np.zeros((dims, CELLS), dtype=np.int64)
    for j in range(dims):
        cell[j] = np.searchsorted(borders[:, j], codes[:, j], side="right")
        start = np.searchsorted(order[:, j], borders[:, j], side="left")
        low[j] = order[np.minimum(np.concatenate([[0], start]), n - 1), j]
        high[j] = order[np.maximum(np.concatenate([start, [n]]) - 1, 0), j]
    return cell, low, high


def _narrow(codes: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    most = int(np.abs(codes).max()) if codes.size else 0
    return codes.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _record(values: dict[str, object], extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    kinds = {"dims": pa.int32(), "width": pa.int32()}
    columns = {name: pa.array([values.get(name)], kinds.get(name, pa.binary())) for name in FIELDS} | (extra or {})
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Block:
    """The vectors of one record."""

    def __init__(self, record: dict[str, object]):
        self.ids, self.labels = (np.frombuffer(record[c], dtype=np.int64) for c in ("ids", "labels"))
        self.n, self.dims = len(self.ids), record["dims"]
        self.codes = np.frombuffer(record["codes"], dtype=f"i{record['width']}").reshape(self.n, self.dims)
        self.anchor = np.frombuffer(record["anchor"], dtype=bool) if record["anchor"] else None
        self.wanted = np.frombuffer(record["wanted"], dtype=np.int64).reshape(self.n, -1) if record["wanted"] else None
        self.largest = float(np.abs(self.codes.astype(np.int64)).max()) if self.codes.size else 0.0
        if record["cells"] is not None:
            cells = np.frombuffer(record["cells"], dtype=np.uint8).reshape(self.dims, self.n)
            self.at = cells + CELLS * np.arange(self.dims, dtype=np.int64)[:, None]
            self.low, self.high = (np.frombuffer(record[c], dtype=np.int64).reshape(self.dims, CELLS) for c in ("low", "high"))

    def fitted(self, anchors: Block) -> np.ndarray:
        """The codes of anchors in this block's dimensions: others meet no code here."""
        if self.largest * anchors.largest * min(self.dims, anchors.dims) >= LARGEST:
            raise ValueError("scores don't fit a long")
        out = np.zeros((anchors.n, self.dims), dtype=np.int64)
        shared = min(self.dims, anchors.dims)
        out[:, :shared] = anchors.codes[:, :shared]
        return out

    def bounds(self, code: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some vectors with one code, by looking up what each of their cells adds."""
        a, b = code[:, None] * self.low, code[:, None] * self.high
        at = self.at[:, rows]
        return tuple(table.ravel().take(at).sum(axis=0) for table in (np.minimum(a, b), np.maximum(a, b)))

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scores(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.codes[rows].astype(np.int64) @ code


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:most]


def positives_in(block: Block, anchors: Block, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor id, its score with nothing, other id, score) of each anchor's best vectors of its own label in a block."""
    codes = block.fitted(anchors)
    for i in range(anchors.n):
        rows = block.of_label(anchors.labels[i])
        others = np.arange(rows.start, rows.stop)
        if not len(others):
            continue
        low, high = block.bounds(codes[i], rows)
        other = block.ids[rows] != anchors.ids[i]
        others, low, high = others[other], low[other], high[other]
        if len(others) > most:
            others = others[high >= np.partition(low, len(low) - most)[len(low) - most]]
        scores = block.scores(codes[i], others)
        top = best(block.ids[others], scores, most)
        yield np.full(len(top), anchors.ids[i]), np.zeros(len(top), dtype=np.int64), block.ids[others[top]], scores[top]


def negatives_in(block: Block, anchors: Block, most: int, window: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor id, positive's score, other id, score) of the best vectors of other labels in each window of each anchor in a block.

    A vector is scored if its bounds reach into a window and its upper bound isn't below `most` lower bounds of
    vectors that are in that window for certain.
    """
    codes = block.fitted(anchors)
    everything = slice(0, block.n)
    for i in range(anchors.n):
        wanted = np.unique(anchors.wanted[i][anchors.wanted[i] >= 0])
        own = block.of_label(anchors.labels[i])
        if not len(wanted) or own.stop - own.start == block.n:
            continue
        low, high = block.bounds(codes[i], everything)
        other = np.ones(block.n, dtype=bool)
        other[own] = False
        possible, windows = np.zeros(block.n, dtype=bool), []
        for score in wanted.tolist():
            least, greatest = -(-window[0] * score // 100), window[1] * score // 100
            windows.append((score, least, greatest))
            enters = other & (high >= least) & (low <= greatest)
            certain = low[enters & (low >= least) & (high <= greatest)]
            if len(certain) > most:
                enters &= high >= np.partition(certain, len(certain) - most)[len(certain) - most]
            possible |= enters
        rows = np.nonzero(possible)[0]
        scores = block.scores(codes[i], rows)
        for score, least, greatest in windows:
            inside = np.nonzero((scores >= least) & (scores <= greatest))[0]
            top = inside[best(block.ids[rows[inside]], scores[inside], most)]
            yield np.full(len(top), anchors.ids[i]), np.full(len(top), score), block.ids[rows[top]], scores[top]


def approximation_file(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK vectors in the shared folder: (block, BLOCK_SCHEMA), block counted from zero without gaps."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
            order = np.lexsort((ids, labels))
            flags = table.column("anchor").to_numpy(zero_copy_only=False)
            codes = codes_of([np.asarray(v, dtype=np.float64) for v in table.column("vector").to_pylist()])[order]
            cells, low, high = approximate(codes)
            narrow = _narrow(codes)
            values = {
                "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "dims": codes.shape[1], "codes": narrow.tobytes(), "width": narrow.itemsize,
                "anchor": flags[order].tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "high": high.tobytes(),
            }
            return _record(values, {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64())})

        part, size = 0, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            while batch.num_rows:
                take = batch.slice(0, BLOCK - size)
                batch = batch.slice(take.num_rows)
                held.append(take)
                size += take.num_rows
                if size == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, size, number = [], 0, number + 1
        if size:
            yield block(pa.Table.from_batches(held))
        release_memory()

    packed = written(rows.withColumn("part", F.spark_partition_id()).mapInArrow(pack, f"{BLOCK_SCHEMA}, part int, number long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = packed.groupBy(F.col("part").alias("of")).agg(F.count("*").alias("n")).select("of", before.alias("before"))
    return packed.join(F.broadcast(offsets), packed["part"] == offsets["of"]).select((F.col("before") + F.col("number")).alias("block"), *FIELDS)


def anchors_of(file: DataFrame) -> DataFrame:
    """Rows (id, label, code) of the file's anchors; code holds longs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                block = Block(record | {"cells": None, "wanted": None})
                at = np.nonzero(block.anchor)[0]
                columns = [pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array([block.codes[i].astype(np.int64).tobytes() for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code"])

    return file.select("ids", "labels", "dims", "codes", "width", "anchor").mapInArrow(read, "id long, label long, code binary")


def anchor_blocks(anchors: DataFrame, most: int) -> DataFrame:
    """Blocks (BLOCK_SCHEMA) of up to ANCHORS anchors from rows (id, label, code, wanted)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                rows = batch.slice(at, ANCHORS).to_pylist()
                found = [np.frombuffer(r["code"], dtype=np.int64) for r in rows]
                codes = np.zeros((len(rows), max(map(len, found))), dtype=np.int64)
                wanted = np.full((len(rows), most), -1, dtype=np.int64)
                for i, r in enumerate(rows):
                    codes[i, : len(found[i])] = found[i]
                    wanted[i, : len(r["wanted"])] = r["wanted"]
                ids, labels = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("id", "label"))
                yield _record({"ids": ids.tobytes(), "labels": labels.tobytes(), "dims": codes.shape[1], "codes": codes.tobytes(), "width": 8, "wanted": wanted.tobytes()})

    return anchors.select("id", "label", "code", "wanted").mapInArrow(pack, BLOCK_SCHEMA)


def searched(file: DataFrame, anchors: DataFrame, blocks: int, find) -> DataFrame:
    """Rows (anchor, positive_score, other, score) that find(block, anchors) gives for each block with each block of anchors.

    Every block of the file is a group of its own, to which all blocks of anchors go: a task holds one block of each.
    """
    schema = "anchor long, positive_score long, other long, score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = number = None
        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.slice(i, 1).to_pylist()[0]
                if record["kind"] == 0:
                    block, number = Block(record), record["block"]
                elif record["block"] == number:
                    found = list(find(block, Block(record)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["anchor", "positive_score", "other", "score"])
        release_memory()

    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), *FIELDS)
    both = file.select("block", F.lit(0).alias("kind"), *FIELDS).unionByName(asked)
    n = int(file.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(search, schema)


def hard_negatives(
    rows: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors' codes, floor(256 * x) of each component; higher scores come first,
    ties by smaller id. Each anchor has its first `positives` other rows of its label as positives, and each positive
    the first `negatives` rows of another label whose score lies between the window's percentages of the positive's.

    Rows without an id, label or vector, or with a null or non-finite component, take no part. Of rows that share an
    id the smallest by label and vector takes part, so repeated rows count once. What a shorter vector lacks counts as
    zero. Raises where scores don't fit a long. Other columns are ignored; an empty table gives no rows.
    """
    file = approximation_file(usable(rows, id_col, vector_col, label, anchor))
    blocks = file.count()
    if not blocks:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asking = anchors_of(file)
    first = anchor_blocks(asking.withColumn("wanted", F.array().cast("array<bigint>")), positives)
    found = searched(file, first, blocks, lambda block, anchors: positives_in(block, anchors, positives))
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "other"))
    chosen = written(found.withColumn("place", place).where(F.col("place") <= positives).select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))  # at most `positives` scores
    second = anchor_blocks(asking.join(windows, asking["id"] == windows["anchor"]), positives)
    found = searched(file, second, blocks, lambda block, anchors: negatives_in(block, anchors, negatives, window))
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "other"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return chosen.join(ranked, ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.col("vec_id") % 50 == 0)


ORACLE_SQL = f"""
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.code, b.code) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 50 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
), ranked AS (
    SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT alike AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
