"""Balanced choice of kinds: what came up often lately is chosen less."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Choices that are remembered, kinds chosen at a time, and the least weight of a kind.
REMEMBERED = 1000
CHOSEN = 5
LEAST = 1e-6


class Ring:
    """The last `size` kinds and their counts, over any two maps with get and put; changes are kept aside until `store`."""

    def __init__(self, size: int, slots=None, counts=None, total: int = 0):
        self.size, self.slots, self.counts, self.total = size, slots, counts, total
        self.new_slots: dict[int, str] = {}
        self.new_counts: dict[str, int] = {}

    def count(self, kind: str) -> int:
        if kind not in self.new_counts:
            found = self.counts.getValue((kind,)) if self.counts is not None else None
            self.new_counts[kind] = found[0] if found else 0
        return self.new_counts[kind]

    def share(self, kind: str) -> float:
        return self.count(kind) / min(self.total, self.size) if self.total else 0.0

    def push(self, kind: str) -> None:
        slot = self.total % self.size
        if self.total >= self.size:
            old = self.new_slots[slot] if slot in self.new_slots else self.slots.getValue((slot,))[0]
            self.new_counts[old] = self.count(old) - 1
        self.new_slots[slot] = kind
        self.new_counts[kind] = self.count(kind) + 1
        self.total += 1

    def store(self) -> None:
        """Writes changed slots and counts."""
        for slot, kind in self.new_slots.items():
            self.slots.updateValue((slot,), (kind,))
        for kind, n in self.new_counts.items():
            self.counts.updateValue((kind,), (n,))


def chosen(ring: Ring, seed: str, kinds: list[str], n: int) -> list[str]:
    """n different kinds, drawn one after the other in proportion to 1 - share; they are remembered.

    The order of -ln(u)/weight is that of such draws; u is a hash of seed and kind.
    """

    def wait(kind: str) -> tuple[float, str]:
        u = (int(hashlib.md5(f"{seed}/{kind}".encode()).hexdigest()[:8], 16) + 1) / 4294967297.0
        return -math.log(u) / max(1 - ring.share(kind), LEAST), kind

    out = [kind for _, kind in sorted(map(wait, kinds))[:n]]
    for kind in out:
        ring.push(kind)
    return out


def balanced_choices(df: DataFrame, group: Column, key: str, kinds: list[str], n: int = CHOSEN, remembered: int = REMEMBERED, seed: str = "0") -> DataFrame:
    """Adds `chosen`: kinds for each row, in a group's order of keys, weighted by what the rows before were given.

    A task holds one group's last choices, whatever its size; groups are the unit of parallel work.
    """
    marked = df.withColumn("__group", group.cast("string")).repartition("__group").sortWithinPartitions("__group", key)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, chosen array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ring = object(), None
        for batch in batches:
            found = []
            for own, k in zip(batch.column("__group").to_pylist(), batch.column(key).to_pylist()):
                if own != current:
                    current, ring = own, Ring(remembered)
                found.append(chosen(ring, f"{seed}/{own}/{k}", kinds, n))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "chosen"])

    return marked.mapInArrow(run, schema)
