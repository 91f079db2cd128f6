"""Regions of masks against flood fill, dilation and rectangles against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import regions as R


def mask(rng, height, width, share):
    return (np.array([[rng.random() for _ in range(width)] for _ in range(height)]) < share).astype(int)


def runs_of(bits):
    out, bit, n = [], 0, 0
    for x in bits.ravel().tolist():
        if x == bit:
            n += 1
        else:
            out.append(n)
            bit, n = x, 1
    return [*out, n]


def flood(bits, value, steps):
    """Sets of pixels that hang together."""
    height, width = bits.shape
    left = {(r, c) for r in range(height) for c in range(width) if bits[r, c] == value}
    out = []
    while left:
        own, queue = set(), [left.pop()]
        while queue:
            r, c = queue.pop()
            own.add((r, c))
            for dr, dc in steps:
                if (r + dr, c + dc) in left:
                    left.remove((r + dr, c + dc))
                    queue.append((r + dr, c + dc))
        out.append(own)
    return out


SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]
ALL = [*SIDES, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def plain_regions(bits, least):
    padded = np.pad(bits, 1)
    outside = next(s for s in flood(padded, 0, SIDES) if (0, 0) in s)
    out = []
    for own in flood(bits, 1, ALL):
        rows, columns = [r for r, _ in own], [c for _, c in own]
        x, y, w, h = min(columns), min(rows), max(columns) - min(columns) + 1, max(rows) - min(rows) + 1
        if w * h >= least:
            external = any((r + 1 + dr, c + 1 + dc) in outside for r, c in own for dr, dc in SIDES)
            out.append((y, x, h, w, len(own), external))
    return sorted(out)


@pytest.mark.parametrize("share", [0.1, 0.3, 0.45, 0.6, 0.9])
def test_regions_equal_flood_fill(share):
    rng = random.Random(int(share * 100))
    for height, width in ((1, 1), (1, 9), (9, 1), (12, 17), (23, 8), (30, 30)):
        bits = mask(rng, height, width, share)
        for least in (1, 4, 50):
            found = R.regions_of(runs_of(bits), width, least)
            assert [(f["y"], f["x"], f["h"], f["w"], f["area"], f["external"]) for f in found] == plain_regions(bits, least)
            assert [f["label"] for f in found] == list(range(len(found)))


def test_region_in_a_hole_is_not_external():
    bits = np.ones((9, 9), dtype=int)
    bits[2:7, 2:7] = 0
    bits[4, 4] = 1
    assert [(f["area"], f["external"]) for f in R.regions_of(runs_of(bits), 9, 1)] == [(56, True), (1, False)]


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_dilation(reach):
    rng = random.Random(reach)
    for height, width, share in ((1, 1, 1.0), (7, 11, 0.05), (20, 9, 0.2), (5, 5, 0.0)):
        bits = mask(rng, height, width, share)
        want = np.zeros_like(bits)
        for r, c in zip(*np.nonzero(bits)):
            want[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1] = 1
        grown = R.dilated(runs_of(bits), width, reach)
        assert np.repeat(np.arange(len(grown)) % 2, grown).reshape(height, width).tolist() == want.tolist()


def test_smallest_rectangle():
    rng = np.random.default_rng(4)
    for _ in range(40):
        points = rng.integers(0, 30, (rng.integers(1, 25), 2)).astype(float)
        cx, cy, w, h, angle = R.smallest_rectangle(points)
        a = math.radians(angle)
        turned = (points - [cx, cy]) @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
        assert 0 <= angle < 90 and (np.abs(turned) <= np.array([w, h]) / 2 + 1e-6).all()
        for other in np.radians(np.arange(0, 90, 0.5)):
            spread = points @ np.array([[math.cos(other), -math.sin(other)], [math.sin(other), math.cos(other)]])
            assert w * h <= np.prod(spread.max(axis=0) - spread.min(axis=0)) + 1e-6
    square = np.array([[5, 0], [10, 5], [5, 10], [0, 5]])
    assert R.smallest_rectangle(square) == pytest.approx((5, 5, 50**0.5, 50**0.5, 45))


def test_masks_in_tables(spark):
    rng = random.Random(8)
    masks = [(i, mask(rng, 12, 10, 0.3)) for i in range(20)]
    rows = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in masks] + [(99, None)], "id int, bits array<int>")
    coded = rows.select("id", F.when(F.col("bits").isNotNull(), R.run_lengths(F.col("bits"))).alias("runs"), F.lit(10).alias("width"))
    assert {r.id: r.runs for r in coded.collect()} == {99: None} | {i: runs_of(m) for i, m in masks}
    areas = {r.id: r.a for r in coded.where("id < 99").select("id", R.run_area(F.col("runs")).alias("a")).collect()}
    assert areas == {i: int(m.sum()) for i, m in masks}
    found = {r.id: r.regions for r in R.mask_regions(coded, "runs", "width", 4, grow=1).collect()}
    assert found.pop(99) is None
    for i, m in masks:
        grown = np.repeat(np.arange(len(g := R.dilated(runs_of(m), 10, 1))) % 2, g).reshape(12, 10)
        assert [(f.y, f.x, f.h, f.w, f.area, f.external) for f in found[i]] == plain_regions(grown, 4)
