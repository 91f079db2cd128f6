"""Model-backed scores behind one interface: a scorer turns batches of rows into batches of columns."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomspark.session import small_batches


@dataclass(frozen=True)
class Scorer:
    """name; input columns; output columns as DDL; setup() loads a model once a task; batch(model, frame) scores, or batch(model, frame, key) where there are keys."""

    name: str
    inputs: tuple[str, ...]
    output: str
    batch: Callable[..., pd.DataFrame]
    setup: Callable[[], object] = lambda: None


def within(seconds: float | None, call: Callable[[], pd.DataFrame]) -> pd.DataFrame:
    """The call's result, or TimeoutError after so many seconds; what hangs is left behind in a daemon thread."""
    if seconds is None:
        return call()
    done: list[tuple[bool, object]] = []

    def run() -> None:
        try:
            done.append((True, call()))
        except BaseException as problem:  # noqa: BLE001  raised again below
            done.append((False, problem))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise TimeoutError(f"no answer within {seconds:g} s")
    good, value = done[0]
    if not good:
        raise value
    return value


class RateLimited(Exception):
    """What a keyed scorer raises when its key may make no more calls for now."""


class KeyRing:
    """Keys in turn, shared by the calls of a task; a key that is limited gives way to the next one, once for all calls that met it."""

    def __init__(self, keys: tuple[str, ...]):
        self.keys, self.at, self.lock = keys, 0, threading.Lock()

    def current(self) -> str:
        return self.keys[self.at]

    def give_up(self, key: str) -> None:
        with self.lock:
            if self.keys[self.at] == key:
                self.at = (self.at + 1) % len(self.keys)


@dataclass(frozen=True)
class Calls:
    """How a scorer is called: tries, seconds between them (times `growth` after each), seconds that a call may take,
    calls at a time, rows of a call (by default a whole batch, or one where there are several calls), and keys.
    """

    tries: int = 3
    pause: float = 0.0
    growth: float = 2.0
    limit: float | None = None
    workers: int = 1
    rows: int | None = None
    keys: tuple[str, ...] = ()

    def answer(self, scorer: Scorer, model: object, frame: pd.DataFrame, ring: KeyRing | None) -> pd.DataFrame:
        """One call's result. A limited key is replaced without using up a try, as often as there are keys."""
        for _ in range(len(self.keys) or 1):
            key = ring.current() if ring else None
            try:
                return within(self.limit, lambda: scorer.batch(model, frame, key) if ring else scorer.batch(model, frame))  # noqa: B023
            except RateLimited:
                if ring is None:
                    raise
                ring.give_up(key)
        raise RateLimited("all keys are limited")

    def scored(self, scorer: Scorer, model: object, frame: pd.DataFrame, ring: KeyRing | None, names: list[str]) -> tuple[pd.DataFrame, list[str | None]]:
        """Results and errors of some rows: after `tries` failures they are scored one by one, and what fails gets nulls."""
        wait = self.pause
        for attempt in range(self.tries):
            try:
                made = self.answer(scorer, model, frame, ring)[names].reset_index(drop=True)
                if len(made) != len(frame):
                    raise ValueError(f"{len(made)} results for {len(frame)} rows")
                return made, [None] * len(frame)
            except Exception:  # noqa: BLE001  any failure of a model is data here
                if wait and attempt + 1 < self.tries:
                    time.sleep(wait)
                    wait *= self.growth
        rows, errors = [], []
        for i in range(len(frame)):
            try:
                rows.append(self.answer(scorer, model, frame.iloc[i : i + 1], ring)[names].iloc[0].to_dict())
                errors.append(None)
            except Exception as problem:  # noqa: BLE001
                rows.append(dict.fromkeys(names))
                errors.append(f"{type(problem).__name__}: {problem}")
        return pd.DataFrame(rows, columns=names), errors


def apply_scorer(df: DataFrame, scorer: Scorer, tries: int = 3, pause: float = 0.0, limit: float | None = None, calls: Calls | None = None) -> DataFrame:
    """Adds the scorer's columns and <name>_error. A batch that fails `tries` times is scored row by row; a row that fails gets nulls and its error.

    `limit` is the seconds that one call may take, a longer one counts as failed. `calls` says more (see Calls): with
    several workers a task waits for that many answers at a time, and with keys the scorer is called as
    batch(model, frame, key). Batches end at 4 MB (unless the session sets another size), for a chain of scorers has a
    worker for each of them in every task.
    """
    small_batches(df.sparkSession)
    calls = calls or Calls(tries, pause, limit=limit)
    added = T.StructType.fromDDL(scorer.output)
    schema = T.StructType([*df.schema.fields, *added.fields, T.StructField(f"{scorer.name}_error", T.StringType())])
    names = [f.name for f in added.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer.setup()
        ring = KeyRing(calls.keys) if calls.keys else None
        with ThreadPoolExecutor(calls.workers) as pool:
            for frame in frames:
                inputs = frame[list(scorer.inputs)]
                size = calls.rows or (len(frame) if calls.workers == 1 else 1)
                parts = [inputs.iloc[at : at + size] for at in range(0, len(inputs), max(size, 1))]
                done = list(pool.map(lambda part: calls.scored(scorer, model, part, ring, names), parts))
                made = pd.concat([m for m, _ in done], ignore_index=True) if done else pd.DataFrame(columns=names)
                out = pd.concat([frame.reset_index(drop=True), made], axis=1)
                out[f"{scorer.name}_error"] = [e for _, errors in done for e in errors]
                yield out

    return df.mapInPandas(run, schema)


def _unit(text: str, salt: str) -> float:
    return int.from_bytes(hashlib.md5(f"{salt}{text}".encode()).digest()[:4], "big") / 2**32


def stand_in(name: str, column: str, low: float, high: float) -> Scorer:
    """A deterministic score for tests and dry runs: a hash of the input between low and high."""
    return Scorer(name, (column,), f"{name} double", lambda _, f: pd.DataFrame({name: [low + (high - low) * _unit(str(x), name) for x in f[column]]}))


#: Stand-ins for the quality scores; real models implement the same interface.
STAND_INS = {
    "aesthetic": stand_in("aesthetic", "payload", 1.0, 10.0),
    "liqe": stand_in("liqe", "payload", 1.0, 5.0),
    "clip_iqa": stand_in("clip_iqa", "payload", 0.0, 1.0),
}


def chained(df: DataFrame, stages: list[tuple[Scorer, str]], tries: int = 3, calls: Calls | None = None) -> DataFrame:
    """Scorers in order, each followed by its gate (a SQL condition), so that costly models see only what cheaper gates kept."""
    for scorer, gate in stages:
        df = apply_scorer(df, scorer, tries, calls=calls).where(gate)
    return df
