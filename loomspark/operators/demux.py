"""A demultiplexer with bounded buffers: children ask in turn, and what others will ask for is parked."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parked rows for each class beyond which the largest buffer hands over, rows that may be parked in all, and the share of those that counts as full.
PER_CLASS = 50
BUFFER = 1000
FULL = 0.75
#: Columns that the demultiplexer adds: who gets the row, its number among all that go out, and whether it was meant for another child.
ADDED = "child int, place long, handed_over boolean"


class Demux:
    """Deals items to children 0 to classes-1, who ask one after the other, again and again.

    A child that asks gets the first item parked for it. If there is none, items are read: its own it gets at once,
    others are parked. When more than `per_class` items a class, or FULL of `buffer`, are parked, the largest buffer
    (the first of equals) hands its first item to the child that asks. `per_class` None leaves out that rule, and
    then more than `buffer` parked items are a BufferError. So no more is ever parked than those bounds.
    """

    def __init__(self, classes: int, per_class: int | None = PER_CLASS, buffer: int = BUFFER, drop_none: bool = True):
        if classes < 1:
            raise ValueError("at least one class is needed")
        self.classes, self.per_class, self.buffer, self.drop_none = classes, per_class, buffer, drop_none
        self.parked: list[deque] = [deque() for _ in range(classes)]
        self.usage = self.asking = self.place = 0

    def _out(self, item: object, handed_over: bool = False) -> tuple[object, int, int, bool]:
        out = item, self.asking, self.place, handed_over
        self.asking = (self.asking + 1) % self.classes
        self.place += 1
        return out

    def feed(self, kind: int | None, item: object) -> Iterator[tuple[object, int, int, bool]]:
        """Reads one item; gives (item, child, place, handed over) for all that go out before the next one must be read."""
        if kind is None and self.drop_none:
            return
        if kind is None or not 0 <= kind < self.classes:
            raise ValueError(f"class {kind} out of range")
        if kind == self.asking and not self.parked[kind]:
            yield self._out(item)
        else:
            self.parked[kind].append(item)
            self.usage += 1
            if self.per_class is not None and (self.usage > self.per_class * self.classes or self.usage > FULL * self.buffer):
                largest = max(range(self.classes), key=lambda k: len(self.parked[k]))
                self.usage -= 1
                yield self._out(self.parked[largest].popleft(), largest != self.asking)
            elif self.usage > self.buffer:
                raise BufferError(f"over {self.buffer} rows are parked")
        while self.parked[self.asking]:
            self.usage -= 1
            yield self._out(self.parked[self.asking].popleft())

    def flush(self) -> Iterator[tuple[object, int, int, bool]]:
        """After the last item: what is parked, to children in turn; those who have none left are passed over."""
        while self.usage:
            if self.parked[self.asking]:
                self.usage -= 1
                yield self._out(self.parked[self.asking].popleft())
            else:
                self.asking = (self.asking + 1) % self.classes


def demultiplexed(df: DataFrame, group: Column, order: list[str], kind: Column, classes: int, per_class: int | None = PER_CLASS, buffer: int = BUFFER, drop_none: bool = True) -> DataFrame:
    """All rows in one pass, each with ADDED; every group (such as a reading worker) has a demultiplexer of its own.

    Rows of a group are read in the given order. A task holds the parked rows of one group and one batch, whatever a
    group's size; groups are the unit of parallel work. A class out of range raises; null goes, or raises.
    """
    marked = df.withColumns({"__group": group, "__kind": kind.cast("int")}).repartition("__group").sortWithinPartitions("__group", *order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {ADDED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, demux, kinds = object(), None, None

        def made(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                rows = pa.Table.from_pylist([item for item, *_ in found], kinds).to_batches()
                added = [pa.array(c, t) for c, t in zip(list(zip(*found))[1:], (pa.int32(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*rows[0].columns, *added], names=[*kinds.names, "child", "place", "handed_over"])

        for batch in batches:
            kinds = pa.schema(list(batch.schema)[:-2])
            groups, classes_ = batch.column("__group").to_pylist(), batch.column("__kind").to_pylist()
            found: list[tuple] = []
            for item, own, k in zip(batch.select(kinds.names).to_pylist(), groups, classes_):
                if own != current:
                    if demux is not None:
                        found += demux.flush()
                    current, demux = own, Demux(classes, per_class, buffer, drop_none)
                found += demux.feed(k, item)
            yield from made(found)
        if demux is not None:
            yield from made(list(demux.flush()))

    return marked.mapInArrow(run, schema)
