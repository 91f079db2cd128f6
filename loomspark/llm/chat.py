"""Chat formatting: a hidden Markov model recovers the roles of transcript lines before canonical rendering."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checkpoint, chunks, small_batches

ROLES = ("system", "user", "assistant")
#: Names that speakers go by in source columns and line markers.
ALIASES = {
    "system": 0, "developer": 0, "context": 0, "instruction": 0, "instructions": 0,
    "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1, "prompt": 1, "prompter": 1, "student": 1, "inst": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "chatbot": 2, "answer": 2, "a": 2, "response": 2, "agent": 2, "output": 2,
}
_NAMES = "|".join(sorted(ALIASES, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*(?P<tag>{_NAMES})\s*(?:\|>)?|\[(?P<box>{_NAMES})\]|(?:#{{1,6}}\s*|\*\*|>\s*)?(?P<name>{_NAMES})\s*(?:\*\*)?\s*:(?:\*\*)?)\s*", re.I)
END_MARK = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|\[/INST\]|</s>)\s*$", re.I)

#: Log-probabilities from one line to the next inside a message part; only a message's start or a marker makes a switch likely.
STAY = ((-0.02, -5.0, -5.5), (-6.0, -0.02, -5.0), (-6.0, -5.0, -0.02))
#: Score of a line whose marker, or a message whose source role, names the state; the other states get nothing.
MARKED, SOURCED = 12.0, 9.0
#: Rows or bytes of one conversation beyond which it is spread over tasks by ranges of its turns, and bytes of such a range.
LARGE, LARGE_BYTES, RANGE_BYTES = 50_000, 16 << 20, 8 << 20
NEVER = float("-inf")

#: Line features of a message part: its size in half powers of two with its number of lines, then three yes-or-no features.
SIZES, LINES = 41, 5
VALUES = (SIZES * LINES, 2, 2, 2)
#: What the model takes for granted before it has counted anything, worth PRIOR messages of each role: the size's mean and
#: deviation in powers of two, the shares of yes, the first role, and the next role.
PRIOR = 10.0
PRIOR_SIZE = ((7.5, 1.5), (6.5, 1.7), (9.0, 1.7))
PRIOR_YES = ((0.02, 0.3, 0.05), (0.1, 0.05, 0.25), (0.4, 0.02, 0.02))
PRIOR_FIRST = (0.3, 0.67, 0.03)
PRIOR_NEXT = ((0.05, 0.9, 0.05), (0.02, 0.2, 0.78), (0.02, 0.75, 0.23))


def features(lines: list[str]) -> tuple[int, int, int, int]:
    """Values of the features of a message part."""
    body = "\n".join(lines).strip()
    size = min(int(2 * math.log2(1 + len(body))), SIZES - 1)
    rich = any(x.lstrip().startswith(("```", "- ", "* ", "1. ", "|")) for x in lines)
    briefs = body[:40].lower().startswith(("you are ", "act as ", "your task"))
    return size * LINES + min(len(lines), LINES) - 1, int(body.endswith("?")), int(rich), int(briefs)


@dataclass(frozen=True)
class Model:
    """Log-probabilities: of the first role, of the next role given the one before, and of each feature's value given the role."""

    first: tuple[float, ...]
    next: tuple[tuple[float, ...], ...]
    emit: tuple[tuple[tuple[float, ...], ...], ...]  # feature, value, role

    @classmethod
    def of(cls, first: np.ndarray, following: np.ndarray, counts: list[np.ndarray]) -> Model:
        """From counts (3), (3, 3) and (values, 3) on top of the prior."""
        sizes = np.arange(SIZES)[:, None] / 2
        mean, deviation = (np.array([x[i] for x in PRIOR_SIZE]) for i in (0, 1))
        bell = np.exp(-((sizes - mean) ** 2) / (2 * deviation**2)) + 1e-4
        shapes = np.repeat(bell / bell.sum(axis=0) / LINES, LINES, axis=0)
        priors = [shapes, *(np.array([[1 - x for x in yes], yes]) for yes in PRIOR_YES)]
        emit = []
        for prior, count in zip(priors, counts):
            total = PRIOR * prior + count
            emit.append(np.log(total / total.sum(axis=0)))
        first = PRIOR * np.array(PRIOR_FIRST) + first
        following = PRIOR * np.array(PRIOR_NEXT) + following
        frozen = lambda x: tuple(map(frozen, x)) if getattr(x, "ndim", 0) else float(x)
        return cls(frozen(np.log(first / first.sum())), frozen(np.log(following / following.sum(axis=1, keepdims=True))), tuple(map(frozen, emit)))

    def score(self, lines: list[str]) -> list[float]:
        found = features(lines)
        return [sum(table[value][s] for table, value in zip(self.emit, found)) for s in range(3)]


UNTRAINED = Model.of(np.zeros(3), np.zeros((3, 3)), [np.zeros((n, 3)) for n in VALUES])


def read_line(line: str) -> tuple[int | None, str]:
    """The role that the line's marker names, and the line without markers."""
    marked = None
    if m := MARKER.match(line):
        marked = ALIASES[(m["tag"] or m["box"] or m["name"]).lower()]
        line = line[m.end() :]
    return marked, END_MARK.sub("", line)


def message(text: str, role: str | None, model: Model = UNTRAINED) -> tuple[list[list[float]], list[bool], list[str]]:
    """Line scores, whether each line starts a part of the message, and the lines without markers.

    A part begins with the message or with a marker; its features count at its first line.
    """
    read = [read_line(x) for x in text.split("\n")]
    lines = [x for _, x in read]
    starts = [i == 0 or marked is not None for i, (marked, _) in enumerate(read)]
    scores = [[0.0, 0.0, 0.0] for _ in read]
    at = [i for i, start in enumerate(starts) if start]
    for begin, end in zip(at, [*at[1:], len(lines)]):
        scores[begin] = model.score(lines[begin:end])
        if (marked := read[begin][0]) is not None:
            scores[begin][marked] += MARKED
    if role is not None and (known := ALIASES.get(role.strip().lower())) is not None:
        scores[0][known] += SOURCED
    return scores, starts, lines


def forward(entry: list[float] | None, scores: list[list[float]], starts: list[bool], model: Model = UNTRAINED) -> tuple[list[float], list[tuple[int, int, int]]]:
    """Best scores of each state after the lines, and back pointers. entry: the scores before, None where a conversation begins."""
    back = []
    for own, start in zip(scores, starts):
        if entry is None:
            entry = [a + b for a, b in zip(model.first, own)]
            back.append((0, 0, 0))
            continue
        step, now, at = model.next if start else STAY, [], []
        for s in range(3):
            options = [entry[p] + step[p][s] for p in range(3)]
            best = max(range(3), key=lambda p: (options[p], -p))
            now.append(options[best] + own[s])
            at.append(best)
        entry = now
        back.append(tuple(at))
    return entry, back


def segments(rows: list[tuple], entry: list[float] | None = None, last: int | None = None, before: int | None = None, final: bool = True, model: Model = UNTRAINED) -> list[tuple]:
    """Viterbi over rows of one conversation: (conv, turn, part, role, continues, text, rendered).

    Where the conversation crosses partitions, entry has the scores and before the state in front of the rows,
    last the state of their last line, and final says whether the conversation ends with them.
    """
    pointers, now = [], entry
    for *_, scores, starts, _lines in rows:
        now, back = forward(now, scores, starts, model)
        pointers += back
    state = last if last is not None else max(range(3), key=lambda s: (now[s], -s))
    path = []
    for back in reversed(pointers):
        path.append(state)
        state = back[state]
    path.reverse()
    pieces, at = [], 0
    for conv, turn, scores, _starts, lines in rows:
        states = path[at : at + len(lines)]
        at += len(lines)
        part = begin = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or states[i] != states[begin]:
                pieces.append((conv, turn, part, states[begin], "\n".join(lines[begin:i]).strip("\n")))
                part, begin = part + 1, i
    out = []
    for i, (conv, turn, part, role, text) in enumerate(pieces):
        previous = pieces[i - 1][3] if i else before
        lead = "" if previous == role else f"<|{ROLES[role]}|>\n" if previous is None else f"<|end|>\n<|{ROLES[role]}|>\n"
        rendered = lead + text + ("\n<|end|>\n" if final and i == len(pieces) - 1 else "\n")
        out.append((conv, turn, part, ROLES[role], previous == role, text, rendered))
    return out


def _rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple]:
    for batch in chunks(batches, "__text"):
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield (conv, turn, *message(text, role, model))


def _conversations(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        if held and held[-1][0] != row[0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _segment_matrix(rows: list[tuple], model: Model) -> list[list[float]]:
    """Best score from each state before the rows to each state after them."""
    out = []
    for s in range(3):
        entry = [0.0 if p == s else NEVER for p in range(3)]
        for *_, scores, starts, _lines in rows:
            entry, _ = forward(entry, scores, starts, model)
        out.append(entry)
    return out


def _laid_out(source: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows sorted by conversation: whole ones in one partition each, and, if any, the large ones by ranges of their turns."""
    order = ["__id", "__turn", "__role", "__text"]
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = source.groupBy("__id").agg(F.count("*").alias("n"), F.sum(F.octet_length("__text")).alias("bytes")).where((F.col("n") > LARGE) | (F.col("bytes") > LARGE_BYTES))
    large = checkpoint(sizes.select(F.col("__id").alias("__large"), "bytes"))
    total = large.agg(F.sum("bytes"), F.count("*")).first()
    if not total[1]:
        return source.repartition(partitions, "__id").sortWithinPartitions(*order), None
    marked = F.col("__id").eqNullSafe(F.col("__large"))
    small = source.join(large, marked, "left_anti").repartition(partitions, "__id").sortWithinPartitions(*order)
    ranges = max(partitions, (total[0] or 0) // RANGE_BYTES + 1)
    return small, checkpoint(source.join(large, marked, "left_semi").repartitionByRange(ranges, *order).sortWithinPartitions(*order))


def _source(rows: DataFrame, id_col: str, turn_col: str, text_col: str, role_col: str | None) -> DataFrame:
    role = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    return small_batches(rows).select(F.col(id_col).alias("__id"), F.col(turn_col).alias("__turn"), role.alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))


COUNTS = "kind int, value int, role int, n long, part int, id string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over sorted rows; kinds 0: first role, 1: next role (value: the one before), 2 on: features, -1 and -2: the first and last row."""
    counts: Counter = Counter()
    head = tail = None
    for batch in chunks(batches, "__text"):
        for conv, _, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            known = -1 if role is None else ALIASES.get(role.strip().lower(), -1)
            if tail is None or tail[0] != conv:
                if tail is None:
                    head = (conv, known)
                elif known >= 0:
                    counts[0, 0, known] += 1
            elif known >= 0 and tail[1] >= 0:
                counts[1, tail[1], known] += 1
            tail = (conv, known)
            if known >= 0:
                _, starts, lines = message(text, None)
                for kind, value in enumerate(features(lines[: starts.index(True, 1)] if any(starts[1:]) else lines), 2):
                    counts[kind, value, known] += 1
    if head is not None:
        part = TaskContext.get().partitionId()
        rows = [(*k, n, part, None) for k, n in counts.items()] + [(-1, 0, head[1], 0, part, repr(head[0])), (-2, 0, tail[1], 0, part, repr(tail[0]))]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "value", "role", "n", "part", "id"])


def fit(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Counts transitions and line features of all given messages by their role; unknown and null roles count nothing.

    What reaches the driver is a count for each feature value and role, and two rows a partition, whose
    conversations may go on in the next one.
    """
    first, following, tables = np.zeros(3), np.zeros((3, 3)), [np.zeros((n, 3)) for n in VALUES]
    for part in _laid_out(_source(rows, id_col, turn_col, text_col, role_col)):
        if part is None:
            continue
        found = checkpoint(part.mapInArrow(_count, COUNTS))
        for kind, value, role, n in found.where("kind >= 0").groupBy("kind", "value", "role").agg(F.sum("n")).collect():
            if kind == 0:
                first[role] += n
            elif kind == 1:
                following[value, role] += n
            else:
                tables[kind - 2][value, role] += n
        tail = None
        for kind, role, conv in found.where("kind < 0").orderBy("part", F.desc("kind")).select("kind", "role", "id").collect():
            if kind == -1 and role >= 0:
                if tail is None or tail[0] != conv:
                    first[role] += 1
                elif tail[1] >= 0:
                    following[tail[1], role] += 1
            elif kind == -2:
                tail = (conv, role)
    return Model.of(first, following, tables)


def parse_transcripts(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = None, model: Model = UNTRAINED) -> DataFrame:
    """Segments of each message by recovered role: id, turn, part, role, continues, text, rendered.

    A message's lines are read in turn order (ties by source role and text; null turns first). The model sees
    speaker markers, the shape of lines, and, with `role_col`, the source's role name as one more marker; an
    unknown or null name says nothing. Without `model` (from `fit`) its prior decides. Joined in order, `rendered`
    is the canonical transcript: one header and one end mark for each run of lines of one role. Null text counts
    as empty (one empty segment); rows with a null id form one conversation; repeated rows are separate messages;
    equal scores go to the first of ROLES; an empty table gives no rows.

    Conversations meet in one partition, sorted; those of more than LARGE rows or LARGE_BYTES bytes are spread by
    ranges of turns. There each range's best scores from state to state (nine numbers) go to the driver, at most
    two a partition, which fixes the states at the borders; the ranges then resolve on their own.
    """
    source = _source(rows, id_col, turn_col, text_col, role_col)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"`{id_col}` {kinds['__id']}, `{turn_col}` {kinds['__turn']}, part long, role string, continues boolean, text string, rendered string"
    names = [id_col, turn_col, "part", "role", "continues", "text", "rendered"]

    def batch_of(found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), types)], names=names)

    def types_of(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def resolve(batches, carried: dict[int, dict] | None = None):
        types: list[pa.DataType] = []

        def noted():
            for batch in batches:
                types[:] = types_of(batch)
                yield batch

        number = TaskContext.get().partitionId()
        own = (carried or {}).get(number, {})
        held, buffer, first = None, [], True
        for conversation in _conversations(_rows(noted(), model)):
            if held is not None:
                entry, before = own["head"] if first and "head" in own else (None, None)
                buffer += segments(held, entry, None, before, model=model)
                first = False
                if len(buffer) >= 2000:
                    yield batch_of(buffer, types)
                    buffer = []
            held = conversation
        if held is not None:
            entry, before = own["head"] if first and "head" in own else (None, None)
            buffer += segments(held, entry, own.get("tail"), before, "tail" not in own, model)
        if buffer:
            yield batch_of(buffer, types)

    small, wide = _laid_out(source)
    if wide is None:
        return small.mapInArrow(resolve, schema)

    def borders(batches):
        number, ends, count = TaskContext.get().partitionId(), [], 0
        for conversation in _conversations(_rows(batches, model)):
            count += 1
            begin = None
            for *_, scores, starts, _lines in conversation:
                begin, _ = forward(begin, scores, starts, model)
            ends = ends[:1] + [(repr(conversation[0][0]), _segment_matrix(conversation, model), begin)]
        for place, (key, matrix, begin) in enumerate(ends):
            yield pa.RecordBatch.from_pydict({"number": [number], "place": [place], "only": [count == 1], "key": [key], "matrix": [sum(matrix, [])], "begin": [begin]})

    ends = wide.mapInArrow(borders, "number long, place long, only boolean, key string, matrix array<double>, begin array<double>").collect()  # at most two a partition
    shared = _carry(sorted(ends, key=lambda r: (r["number"], r["place"])))
    return small.mapInArrow(resolve, schema).unionByName(wide.mapInArrow(lambda batches: resolve(batches, shared), schema))


def _carry(ends: list) -> dict[int, dict]:
    """States at partition borders: number -> head (scores and state in front of its first conversation) and tail (state at the end of its last)."""
    chains: list[list] = []
    for row in ends:
        if chains and chains[-1][-1]["key"] == row["key"] and chains[-1][-1]["number"] != row["number"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    out: dict[int, dict] = {}
    for chain in (c for c in chains if len(c) > 1):
        scores, pointers = [list(chain[0]["begin"])], []
        for row in chain[1:]:
            matrix = [row["matrix"][3 * p : 3 * p + 3] for p in range(3)]
            options = [[scores[-1][p] + matrix[p][s] for p in range(3)] for s in range(3)]
            pointers.append([max(range(3), key=lambda p: (o[p], -p)) for o in options])
            scores.append([max(o) for o in options])
        state = max(range(3), key=lambda s: (scores[-1][s], -s))
        for i in range(len(chain) - 1, -1, -1):
            own = out.setdefault(chain[i]["number"], {})
            if i < len(chain) - 1:
                own["tail"] = state
            if i:
                own["head"] = (scores[i - 1], pointers[i - 1][state])
                state = pointers[i - 1][state]
    return out


def held_out(column: str):
    """A quarter of the conversations by their id's checksum, from whose roles nothing is learnt."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_transcript_roles(spark, sf_dir: str) -> DataFrame:
    """Roles of all messages from their text and order; the given roles are only counted, in the conversations that aren't held out."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return parse_transcripts(rows, model=fit(rows.where(~held_out("conv_id"))))
