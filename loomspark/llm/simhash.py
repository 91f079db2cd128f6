"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checkpoint, chunks, mix, small_batches
from loomspark.llm.components import connected_components

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
#: Bits of the blocks in which pivots differ. Four differing bits leave three of seven blocks untouched.
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
AGREE = len(WIDTHS) - MAX_DISTANCE
#: Pivots spread at random, whose distances discard pairs before the exact check.
FILTER_PIVOTS = 16
#: Half blocks of the four blocks that a cell leaves open, and how many of those agree at least.
OPEN, OPEN_AGREE = 8, 4
#: Fingerprints that are searched one by one; fuller cells are split by the coordinates of half blocks first.
SEARCHED = 512
#: Fingerprints that one cell may hold in a task's memory; the parts of a fuller one are dealt out to tasks of their own.
CELL_MAX = 1 << 17


def _pivots() -> tuple[np.uint64, list[list[np.uint64]], np.ndarray]:
    """The base pivot; for each block, pivots that flip ever more of its bits; and the spread ones."""
    words = [xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(FILTER_PIVOTS + 1)]
    base, at, blocks = words[0], 0, []
    for width in WIDTHS:
        flips, mask = [], 0
        for bit in range(at, at + width):
            mask |= 1 << bit
            flips.append(np.uint64(base ^ mask))
        blocks.append(flips)
        at += width
    return np.uint64(base), blocks, np.array(words[1:], dtype=np.uint64)


BASE, BLOCK_PIVOTS, SPREAD = _pivots()


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, 4-word shingles with repeats."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n)) + np.arange(n)
    begins = np.concatenate([[0], ends[:-1] + 1])[: n - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * counts > len(hashes))[0].tolist())


def add_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, fingerprint as signed long)."""
    source = small_batches(docs).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            found = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp long")


def distance_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to pivots (columns)."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int16)


def coordinates(prints: np.ndarray) -> list[np.ndarray]:
    """Block coordinates: along the pivots of a block the distance rises or falls by one a step, and the steps are the coordinate."""
    out = []
    for flips in BLOCK_PIVOTS:
        table = distance_table(prints, np.array([BASE, *flips], dtype=np.uint64))
        rises = (np.diff(table, axis=1) > 0).astype(np.int64)
        out.append(rises @ (1 << np.arange(rises.shape[1], dtype=np.int64)))
    return out


CHOICES = list(combinations(range(len(WIDTHS)), AGREE))
OPEN_CHOICES = list(combinations(range(OPEN), OPEN_AGREE))


def cells(prints: np.ndarray) -> np.ndarray:
    """Cell numbers of each fingerprint, one for each choice of AGREE blocks.

    Fingerprints within MAX_DISTANCE agree in all coordinates of AGREE blocks at least, and so share a cell.
    """
    block = coordinates(prints)
    out = np.empty((len(prints), len(CHOICES)), dtype=np.int64)
    for number, chosen in enumerate(CHOICES):
        cell = np.full(len(prints), number, dtype=np.int64)
        for b in chosen:
            cell = (cell << 10) | block[b]
        out[:, number] = cell
    return out


def parts(prints: np.ndarray, cell: int) -> Iterator[np.ndarray]:
    """Numbers of the parts of a cell that each fingerprint belongs to, for one choice of OPEN_AGREE half blocks after the other.

    A cell fixes AGREE blocks. The four others make eight halves, of which at most MAX_DISTANCE differ in what is
    linked, so that two linked fingerprints share a part. A part fixes 46 of the 64 bits: it has 2**18 at most.
    """
    block = coordinates(prints)
    halves = [h for b in range(len(WIDTHS)) if b not in CHOICES[cell >> 10 * AGREE] for h in (block[b] & 31, block[b] >> 5)]
    for chosen in OPEN_CHOICES:
        key = np.zeros(len(prints), dtype=np.int64)
        for h in chosen:
            key = (key << 5) | halves[h]
        yield key


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair whether it lies within MAX_DISTANCE: first by the largest coordinate difference, then exactly."""
    difference = np.abs(distance_table(a, SPREAD) - distance_table(b, SPREAD)).max(axis=1)
    kept = difference <= MAX_DISTANCE
    kept[kept] = np.bitwise_count(a[kept] ^ b[kept]) <= MAX_DISTANCE
    return kept


def search(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among some fingerprints: a search over those not reached so far.

    Their distances to the spread pivots are computed once; the search discards by the largest coordinate
    difference and verifies the survivors. What is dense is reached from its first members; no pairs are kept.
    """
    table = distance_table(prints, SPREAD)
    rest = np.arange(len(prints))
    found: list[tuple[int, int]] = []
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            x = queue.pop()
            possible = np.abs(table[rest] - table[x]).max(axis=1) <= MAX_DISTANCE
            possible[possible] = np.bitwise_count(prints[rest[possible]] ^ prints[x]) <= MAX_DISTANCE
            reached = rest[possible]
            rest = rest[~possible]
            found += [(root, int(y)) for y in reached]
            queue += reached.tolist()
    return found


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def link_cell(prints: np.ndarray, cell: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one cell.

    More than SEARCHED fingerprints are searched part by part. A part of up to eight is compared at once with all
    others of its kind, a larger one by `search`, and one whose members are connected already not at all; so the
    work grows with the members, whether they are linked or not.
    """
    if len(prints) <= SEARCHED:
        return search(prints)
    parent = np.arange(len(prints))
    found: list[tuple[int, int]] = []
    for key in parts(prints, cell):
        order = np.argsort(key, kind="stable")
        first = np.nonzero(np.diff(key[order], prepend=-1))[0]
        size = np.diff(np.append(first, len(order)))
        own = parent[order]
        open_ = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
        left = np.where(open_ & (size <= 8), size, 0)
        links = []
        for shift in range(1, 8):
            a = _stretches(first, np.maximum(left - shift, 0))
            if not len(a):
                break
            x, y = order[a], order[a + shift]
            good = (parent[x] != parent[y]) & near(prints[x], prints[y])
            links += zip(x[good].tolist(), y[good].tolist())
        for k in np.nonzero(open_ & (size > 8))[0].tolist():
            members = order[first[k] : first[k] + size[k]]
            links += [(int(members[a]), int(members[b])) for a, b in search(prints[members])]
        joined = parent.tolist() if links else []
        for a, b in links:
            while joined[a] != a:
                joined[a] = a = joined[joined[a]]
            while joined[b] != b:
                joined[b] = b = joined[joined[b]]
            if a != b:
                joined[max(a, b)] = min(a, b)
                found.append((a, b))
        if links:
            parent = _roots(np.array(joined))
    return found


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of stretches, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _linked(batches: Iterator[pa.RecordBatch], most: int | None, link: Callable[[np.ndarray, int], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """From rows (cell, fp, rep) sorted by cell: rows (a, b, fp, heavy) of links, or of the members (b: the cell) of a cell of over `most`."""
    cell, held, size, heavy = None, [], 0, False
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def out(a, b, fp, flag):
        n = len(a)
        arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fp, pa.int64()), pa.array(np.full(n, flag))]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "fp", "heavy"])

    def close():
        nonlocal held, size, heavy
        if size > 1 and not heavy:
            prints, reps = (np.concatenate(x) for x in zip(*held))
            if links := link(prints.view(np.uint64), int(cell)):
                a, b = np.array(links).T
                pairs.append((reps[a], reps[b]))
        held, size, heavy = [], 0, False

    for batch in batches:
        c, f, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(c):
            continue
        edges = np.concatenate([[0], np.nonzero(np.diff(c))[0] + 1, [len(c)]])
        two = np.nonzero(np.diff(edges) == 2)[0]
        two = two[(two > 0) & (two < len(edges) - 2)]  # cells of two members inside the batch, all at once
        at = edges[two]
        good = near(f[at].view(np.uint64), f[at + 1].view(np.uint64))
        pairs.append((r[at][good], r[at + 1][good]))
        done = set(two.tolist())
        single = np.diff(edges) == 1
        for k in range(len(edges) - 1):
            if 0 < k < len(edges) - 2 and (single[k] or k in done):
                continue
            a, b = edges[k], edges[k + 1]
            if c[a] != cell:
                close()
                cell = c[a]
            held.append((f[a:b], r[a:b]))
            size += int(b - a)
            if heavy or most is not None and size > most:
                heavy = True
                for prints, reps in held:
                    yield out(reps, np.full(len(reps), cell), prints, True)
                held = []
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            yield out(a, b, np.zeros(len(a), dtype=np.int64), False)
            pairs = []
    close()
    for a, b in pairs:
        yield out(a, b, np.zeros(len(a), dtype=np.int64), False)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cell, fp, rep) of overfull cells: a row (part, fp, rep) for each part that a member belongs to."""
    for batch in batches:
        cell, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for c in np.unique(cell).tolist():
            own = np.nonzero(cell == c)[0]
            for number, key in enumerate(parts(fp[own].view(np.uint64), c)):
                # parts of different cells that get one number are verified like any others
                part = mix(mix(np.full(len(own), c * len(OPEN_CHOICES) + number).view(np.uint64)) + key.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(fp[own]), pa.array(rep[own])], names=["cell", "fp", "rep"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp as signed long, component_id), one per input row.

    Texts whose fingerprints differ in at most MAX_DISTANCE bits are linked; component_id is the smallest id
    reachable. Null text counts as empty; a text without words has fingerprint zero, linked like any other.
    Equal fingerprints are folded into one before any join, so a large group of copies costs one row; near
    copies are linked within cells without listing their pairs. Ids should be of type long; a null id gets its
    group's component, or null where the group has no other. Repeated rows come out as often. An empty table
    gives no rows.
    """
    rows = checkpoint(add_fingerprints(docs, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))

    def to_cells(batches):
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at in range(0, len(fp), 8192):
                f, r = fp[at : at + 8192], rep[at : at + 8192]
                found = cells(f.view(np.uint64))
                width = found.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(f, width)), pa.array(np.repeat(r, width))], names=["cell", "fp", "rep"])

    keyed = prints.where("rep IS NOT NULL").select("fp", "rep").mapInArrow(to_cells, "cell long, fp long, rep long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most, schema = CELL_MAX, "a long, b long, fp long, heavy boolean"
    linked = checkpoint(keyed.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _linked(batches, most, link_cell), schema))
    links = linked.where("NOT heavy").select("a", "b").distinct()
    members = linked.where("heavy").select(F.col("b").alias("cell"), "fp", F.col("a").alias("rep"))
    if not members.isEmpty():
        split = members.mapInArrow(_part_rows, "cell long, fp long, rep long").repartition(n, "cell").sortWithinPartitions("cell")
        split = split.mapInArrow(lambda batches: _linked(batches, None, lambda prints, _: search(prints)), schema)  # 2**18 members at most
        links = links.unionByName(split.select("a", "b")).distinct()
    components = connected_components(links)
    named = prints.join(components, prints["rep"] == components["node"], "left").where("n > 1 OR component IS NOT NULL")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, "fp", "left").select(F.col(id_col), "fp", F.coalesce("component_id", F.col(id_col)).alias("component_id"))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
