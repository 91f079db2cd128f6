"""The demultiplexer on streams: what is parked is state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomspark.operators.demux import ADDED, BUFFER, PER_CLASS, Demux


class DemuxProcessor(StatefulProcessor):
    """A demultiplexer for each group. Parked rows are map state, by class and number; a micro-batch writes what it changes.

    Rows that come and go within a micro-batch never reach the state, which holds no more than Demux parks.
    """

    def __init__(self, columns: list[str], schema: T.StructType, order: list[str], classes: int, per_class: int | None, buffer: int, drop_none: bool):
        self.columns, self.schema, self.order = columns, schema, order
        self.settings = classes, per_class, buffer, drop_none

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parked = handle.getMapState("parked", "kind int, number long", self.schema)
        self.turn = handle.getValueState("turn", "asking int, place long, number long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        demux, number = Demux(*self.settings), 0
        if self.turn.exists():
            demux.asking, demux.place, number = self.turn.get()
        before = {tuple(k): tuple(v) for k, v in self.parked.iterator()}
        for kind, n in sorted(before):
            demux.parked[kind].append((n, before[kind, n]))
        demux.usage = len(before)
        # a micro-batch comes in any order
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            for (_, item), child, place, handed_over in demux.feed(row["__kind"], (number, tuple(row[c] for c in self.columns))):
                yield Row(**dict(zip(self.columns, item)), child=child, place=place, handed_over=handed_over)
            number += 1
        after = {(kind, n): item for kind, items in enumerate(demux.parked) for n, item in items}
        for k in before.keys() - after.keys():
            self.parked.removeKey(k)
        for k in after.keys() - before.keys():
            self.parked.updateValue(k, after[k])
        self.turn.update((demux.asking, demux.place, number))

    def close(self) -> None:
        pass


def demultiplexed_stream(stream: DataFrame, group: Column, order: list[str], kind: Column, classes: int, per_class: int | None = PER_CLASS, buffer: int = BUFFER, drop_none: bool = True) -> DataFrame:
    """A stream's rows with ADDED, as operators.demux.demultiplexed gives them, in the order of micro-batches.

    Needs the RocksDB state store. A task holds a group's rows of one micro-batch, whose size the source limits.
    """
    processor = DemuxProcessor(stream.columns, stream.schema, order, classes, per_class, buffer, drop_none)
    marked = stream.withColumns({"__group": group, "__kind": kind.cast("int")})
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, {ADDED}"
    return marked.groupBy("__group").transformWithState(processor, outputStructType=schema, outputMode="Append", timeMode="None")
