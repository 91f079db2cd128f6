"""Regions of masks: connected components of run-length-coded masks, dilation, boxes and smallest rectangles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least area of a region's box.
LEAST_BOX = 50
REGION = "label int, area long, x int, y int, w int, h int, cx double, cy double, rect_w double, rect_h double, angle double, external boolean"
FIELDS = [f.split()[0] for f in REGION.split(", ")]
#: Fields of the smallest rectangle, which are found region by region.
RECTANGLE = ["cx", "cy", "rect_w", "rect_h", "angle"]
#: Runs and rows of masks that are searched together.
SHEET = 1 << 18


def run_lengths(bits: Column) -> Column:
    """Lengths of runs of a 0/1 array, row by row, in turn of zeros and of ones; the first is of zeros, if need be of none."""
    start = F.struct(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("bit"), F.lit(0).alias("n"))
    same = lambda a, x: F.struct(a["runs"].alias("runs"), a["bit"].alias("bit"), (a["n"] + 1).alias("n"))
    new = lambda a, x: F.struct(F.concat(a["runs"], F.array(a["n"])).alias("runs"), x.cast("int").alias("bit"), F.lit(1).alias("n"))
    return F.aggregate(bits, start, lambda a, x: F.when(a["bit"] == x, same(a, x)).otherwise(new(a, x)), lambda a: F.concat(a["runs"], F.array(a["n"])))


def run_area(runs: Column) -> Column:
    """Pixels of a run-length-coded mask."""
    return F.aggregate(F.filter(runs, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def segments(runs: np.ndarray, width: int, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last+1 column of each stretch of `bit`, cut at the ends of rows; in order."""
    ends = np.cumsum(runs)
    starts = (ends - runs)[bit::2]
    ends = ends[bit::2]
    some = ends > starts
    starts, ends = starts[some], ends[some]
    pieces = (ends - 1) // width - starts // width + 1
    first = np.repeat(starts, pieces)
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row = first // width + step
    begin = np.where(step == 0, first % width, 0)
    end = np.minimum(np.repeat(ends, pieces) - row * width, width)
    return row, begin, end


def joined(row: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """The component of each segment, as the number of its first one: union-find over segments of neighbouring rows.

    Segments touch if their columns meet; `reach` is 1 where corners count, else 0.
    """
    # of the row above, those that end behind this one's beginning and begin before its end
    stride = int(end.max()) + 2 if len(end) else 1
    begins, ends = row * stride + begin, row * stride + end
    low = np.searchsorted(ends, (row - 1) * stride + begin - reach, side="right")
    high = np.searchsorted(begins, (row - 1) * stride + end + reach, side="left")
    size = np.maximum(high - low, 0)
    here = np.repeat(np.arange(len(row)), size)
    above = np.arange(len(here)) - np.repeat(np.cumsum(size) - size, size) + low[here]
    touch = row[above] == row[here] - 1
    here, above = here[touch], above[touch]
    parent = np.arange(len(row))
    while True:  # the greater root of a pair goes under the lesser one
        a, b = parent[here], parent[above]
        open_ = a != b
        if not open_.any():
            return parent
        here, above, a, b = here[open_], above[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, sides and angle (degrees, 0 to 90) of the smallest rectangle round some points; one side lies on an edge of their hull."""
    hull = convex_hull(points)
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        along = b - a
        if not along.any():
            along = np.array([1.0, 0.0])
        along = along / np.hypot(*along)
        across = np.array([-along[1], along[0]])
        u, v = hull @ along, hull @ across
        w, h = u.max() - u.min(), v.max() - v.min()
        if best is None or w * h < best[0] - 1e-9:
            centre = along * (u.max() + u.min()) / 2 + across * (v.max() + v.min()) / 2
            angle = math.degrees(math.atan2(along[1], along[0])) % 180
            if angle >= 90 - 1e-9:
                angle, w, h = angle - 90, h, w
            best = w * h, (float(centre[0]), float(centre[1]), float(w), float(h), max(0.0, float(angle)))
    return best[1]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, one after the other."""
    points = np.unique(np.asarray(points, dtype=np.float64), axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def regions_of(runs: list[int], width: int, least: int = LEAST_BOX) -> list[dict]:
    """Regions of one mask whose box has at least `least` pixels, from top to bottom, then from left to right.

    Regions hang together by sides or corners. One that lies in a hole of another isn't external.
    """
    lengths = np.asarray(runs, dtype=np.int64)
    counts, columns = regions_of_masks(lengths, np.array([len(lengths)]), np.array([width], dtype=np.int64), least, FIELDS)
    return [dict(zip(FIELDS, row)) for row in zip(*(c.tolist() for c in columns))]


def regions_of_masks(lengths: np.ndarray, sizes: np.ndarray, widths: np.ndarray, least: int, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of regions of each mask, and the named fields of all of them in turn; masks have `sizes` of the lengths one after the other.

    The masks stand below one another on one sheet, an empty row between them, so that arrays do the work of all.
    """
    ends = np.cumsum(lengths)
    first_run = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], ends])
    pixels = before[first_run + sizes] - before[first_run]
    heights = pixels // widths
    mask = np.repeat(np.arange(len(sizes)), sizes)
    odd = (np.arange(len(lengths)) - first_run[mask]) % 2 == 1
    ends = ends - before[first_run][mask]
    top = np.cumsum(heights + 2) - heights - 2  # a mask's first row on the sheet; a cut last row has room, too

    def pieces(which: np.ndarray) -> tuple[np.ndarray, ...]:
        own = np.nonzero(which & (lengths > 0))[0]
        m = mask[own]
        w, start, end = widths[m], ends[own] - lengths[own], ends[own]
        n = (end - 1) // w - start // w + 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        m, w, start, end = (np.repeat(x, n) for x in (m, w, start, end))
        row = start // w + step
        return m, row, np.where(step == 0, start % w, 0), np.minimum(end - row * w, w)

    m, row, begin, end = pieces(odd)
    counts = np.zeros(len(sizes), dtype=np.int64)
    component = joined(top[m] + row, begin, end, 1)
    order = np.argsort(component, kind="stable")
    starts = np.nonzero(np.diff(component[order], prepend=-1))[0]
    first = component[order[starts]]  # a region's first segment
    m_of, r, b, e = m[first], row[order], begin[order], end[order]
    if not len(first):
        return counts, [np.zeros(0)] * len(fields)
    x, y, w = np.minimum.reduceat(b, starts), row[first], np.maximum.reduceat(e, starts)
    w, h, area = w - x, np.maximum.reduceat(r, starts) - y + 1, np.add.reduceat(e - b, starts)
    kept = np.nonzero(w * h >= least)[0]
    kept = kept[np.lexsort([c[kept] for c in (area, w, h, x, y, m_of)])]
    m_of, first = m_of[kept], first[kept]
    np.add.at(counts, m_of, 1)
    label = np.arange(len(kept)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = {"label": label, "area": area[kept], "x": x[kept], "y": y[kept], "w": w[kept], "h": h[kept]}
    if "external" in fields:
        out["external"] = row[first] == 0
        m0, row0, begin0, end0 = pieces(~odd)
        if len(m0):
            component0 = joined(top[m0] + row0, begin0, end0, 0)
            border = np.zeros(len(m0), dtype=bool)
            border[component0[(row0 == 0) | (row0 == heights[m0] - 1) | (begin0 == 0) | (end0 == widths[m0])]] = True
            stride = int(widths.max()) + 1
            # the pixel above a region's first one is background, or lies outside the mask
            above = np.searchsorted((top[m0] + row0) * stride + begin0, (top[m_of] + row[first] - 1) * stride + begin[first], side="right") - 1
            out["external"] = out["external"] | border[component0[above]]
    if set(fields) & set(RECTANGLE):
        bounds = np.append(starts, len(order))
        found = [smallest_rectangle(np.concatenate([np.stack([b[i:j], r[i:j]], 1), np.stack([e[i:j] - 1, r[i:j]], 1)])) for i, j in zip(bounds[kept].tolist(), bounds[kept + 1].tolist())]
        out |= dict(zip(RECTANGLE, np.array(found, dtype=np.float64).reshape(-1, len(RECTANGLE)).T))
    return counts, [out[f] for f in fields]


def dilated(runs: list[int], width: int, reach: int) -> list[int]:
    """The mask grown by `reach` pixels in all eight directions, as a square kernel of 2 * reach + 1 does."""
    lengths = np.asarray(runs, dtype=np.int64)
    height = int(lengths.sum()) // width
    row, begin, end = segments(lengths, width, 1)
    edge = np.zeros((height + 1, width + 1), dtype=np.int64)  # corners of the boxes that segments grow to
    top, bottom = np.maximum(row - reach, 0), np.minimum(row + reach + 1, height)
    left, right = np.maximum(begin - reach, 0), np.minimum(end + reach, width)
    for r, c, sign in ((top, left, 1), (top, right, -1), (bottom, left, -1), (bottom, right, 1)):
        np.add.at(edge, (r, c), sign)
    bits = (edge.cumsum(axis=0).cumsum(axis=1)[:height, :width] > 0).ravel()
    change = np.nonzero(np.diff(bits.view(np.int8), prepend=np.int8(0)))[0]
    return np.diff(np.concatenate([[0], change, [len(bits)]])).tolist()


def mask_regions(df: DataFrame, runs: str, width: str, least: int = LEAST_BOX, grow: int = 0, out: str = "regions", fields: list[str] | None = None) -> DataFrame:
    """Adds `out`, an array of REGION structs, for masks in a column of run lengths (see run_lengths); `grow` dilates them first.

    A mask is one row, so its work is bounded by its runs; null masks have null regions. `fields` names the fields
    that are wanted, all by default: most of the time goes to the smallest rectangles.
    """
    fields = [f for f in FIELDS if fields is None or f in fields]
    kinds = dict(f.split() for f in REGION.split(", "))
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def sheets(lists: pa.Array, widths: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        if grow:
            lists = pa.array([dilated(r, w, grow) for r, w in zip(lists.to_pylist(), widths.tolist())], pa.list_(pa.int64()))
        sizes, lengths = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64)
        bounds, pixels = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(lengths)])
        cost = np.cumsum(sizes + np.diff(pixels[bounds]) // widths)
        at = 0
        while at < len(sizes):
            to = max(int(np.searchsorted(cost, (cost[at - 1] if at else 0) + SHEET, side="right")), at + 1)
            yield regions_of_masks(lengths[bounds[at] : bounds[to]], sizes[at:to], widths[at:to], least, fields)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.and_(pc.is_valid(batch.column(runs)), pc.is_valid(batch.column(width)))
            found = list(sheets(batch.column(runs).filter(known), batch.column(width).filter(known).to_numpy().astype(np.int64)))
            valid = known.to_numpy(zero_copy_only=False)
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            if found:
                counts[valid] = np.concatenate([c for c, _ in found])
            columns = [pa.array(np.concatenate([c[i] for _, c in found] or [np.zeros(0)]).astype(types[kinds[f]].to_pandas_dtype()), types[kinds[f]]) for i, f in enumerate(fields)]
            structs = pa.StructArray.from_arrays(columns, fields=[pa.field(f, types[kinds[f]]) for f in fields])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), structs, mask=pa.array(~valid))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    named = ", ".join(f"{f}: {kinds[f].replace('long', 'bigint')}" for f in fields)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<struct<{named}>>"
    return df.mapInArrow(run, schema)


def dilated_masks(df: DataFrame, runs: str, width: str, reach: int, out: str) -> DataFrame:
    """Adds `out`, the run lengths of masks grown by `reach` pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grown = [None if r is None or w is None else dilated(r, w, reach) for r, w in zip(batch.column(runs).to_pylist(), batch.column(width).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grown, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` array<int>")
