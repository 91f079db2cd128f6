"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import tokens
from loomspark.llm.common import release_memory, small_batches

LENGTH = 2048
#: Cost of a piece of n tokens: LINEAR * n for the dense layers plus QUADRATIC * n * n for attention within the piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Sequences that a task fills at a time: bounds its memory to about WINDOW * LENGTH ids.
WINDOW = 512
#: The id that ends every document.
END_ID = 1


def assign(lengths: list[int], bins: int, capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Places pieces of the given lengths in `bins` sequences; returns what each holds and what is left, as (piece, from, to).

    Pieces go in order of falling cost, each to the sequence of least cost that can still take it whole. One
    that fits nowhere whole is cut over the sequences with the most room; what no sequence can take is left.
    """
    room, cost = np.full(bins, capacity, dtype=np.int64), np.zeros(bins)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    left = []

    def put(k: int, piece: int, start: int, end: int) -> None:
        held[k].append((piece, start, end))
        room[k] -= end - start
        cost[k] += LINEAR * (end - start) + QUADRATIC * (end - start) ** 2

    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[piece]
        k = int(np.where(room >= n, cost, np.inf).argmin()) if bins else 0
        if bins and room[k] >= n:
            put(k, piece, 0, n)
            continue
        at = 0
        while at < n and bins and room[k := int(room.argmax())] > 0:
            end = min(n, at + int(room[k]))
            put(k, piece, at, end)
            at = end
        if at < n:
            left.append((piece, at, n))
    return held, left


def _pack(documents: Iterator[tuple[object, np.ndarray]], length: int) -> Iterator[list[tuple[object, int, np.ndarray, int]]]:
    """Sequences, each a list of (doc_id, start, ids, doc_tokens)."""
    waiting: list[tuple[object, int, np.ndarray, int]] = []
    total = 0

    def cut(piece: tuple, start: int, end: int) -> tuple:
        return piece[0], piece[1] + start, piece[2][start:end], piece[3]

    def flush(bins: int) -> Iterator[list[tuple]]:
        nonlocal waiting, total
        held, left = assign([len(p[2]) for p in waiting], bins, length)
        for pieces in held:
            if pieces:
                yield [cut(waiting[i], a, b) for i, a, b in pieces]
        waiting = [cut(waiting[i], a, b) for i, a, b in left]
        total = sum(len(p[2]) for p in waiting)

    for doc_id, ids in documents:
        n, whole = len(ids), len(ids) // length * length
        for at in range(0, whole, length):
            yield [(doc_id, at, ids[at : at + length], n)]
        if n > whole:
            waiting.append((doc_id, whole, ids[whole:].copy(), n))
            total += n - whole
        if total >= WINDOW * length:
            yield from flush(total // length)
    yield from flush(total // length)
    # under one sequence is left of the task's input: cut at powers of two, which need no padding
    rest = sorted(waiting, key=lambda p: -len(p[2]))
    size = 1 << total.bit_length()
    while rest:
        size >>= 1
        if not total & size:
            continue
        out, room = [], size
        while room:
            piece = rest[0]
            take = min(room, len(piece[2]))
            out.append(cut(piece, 0, take))
            room -= take
            rest[:1] = [cut(piece, take, len(piece[2]))] if take < len(piece[2]) else []
        yield out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves with `with_ids`.

    A document's ids are the tokenizer's plus END_ID. Whole multiples of `length` fill sequences of their own;
    the rest is balanced within windows of WINDOW sequences of one task, so packing needs no shuffle and bounded
    memory, and each task leaves under one sequence, which is cut at powers of two. Null text counts as empty
    (one piece of END_ID); repeated rows are packed as often as they come; ids may repeat or be null. An empty
    table gives no rows. Sequence ids are unique and hold the task's number in their high bits.
    """
    path = tokenizer or tokens.default_path()
    source = small_batches(docs).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        encoder = tokens.encoder(path)
        first = TaskContext.get().partitionId() << 36
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        id_arrow = None

        def documents():
            nonlocal id_arrow
            for batch in batches:
                id_arrow = batch.schema.field(0).type
                for k in range(batch.num_rows):
                    ids = encoder.ids(batch.column(1)[k].as_py())
                    yield batch.column(0)[k].as_py(), np.append(ids, np.uint32(END_ID)).astype("<u4")

        def batch_of(rows):
            columns = list(zip(*rows))
            types = [id_arrow] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        rows = []
        for number, pieces in enumerate(_pack(documents(), length)):
            offset = 0
            for doc_id, start, ids, n in pieces:
                row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, first + number, offset)
                rows.append(row + (ids.astype("int32"),) if with_ids else row)
                offset += len(ids)
            if len(rows) >= (500 if with_ids else 8192):
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
        release_memory()

    return source.mapInArrow(run, schema)


def op2_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
