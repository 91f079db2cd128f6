"""Substring dedup by recompression: long repeats found through symbols that equal word runs share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import BASE, chunks, dealt_anew, mix, pack_columns, read_words, release_memory, spans, text_as_bytes, text_back, with_text_key, written

WINDOW = 35
#: Bytes of text that a task parses at a time; small enough for its arrays to stay in the processor's cache.
PARSE_BYTES = 1 << 19
#: Rounds of pair naming after the round that names runs.
ROUNDS = 5
#: Occurrences of one anchor that a task compares at a time; windows of a more frequent one are dealt to parts.
HOT = 20_000
KEY = ["__k1", "__k2"]
#: Key of the text that a stretch is compared with.
OTHER = ["__o1", "__o2"]


@dataclass(frozen=True)
class Anchors:
    """Anchor symbols of some documents, sorted by position, and the windows that each of them answers for."""

    key: np.ndarray
    position: np.ndarray
    window: np.ndarray  # starts, grouped by anchor
    bound: np.ndarray  # of each anchor's group in `window`


def anchors(words: np.ndarray, ends: np.ndarray) -> Anchors:
    """Chooses for each window of WINDOW words one symbol that depends on the window's words alone.

    words: hashes of the words of some documents, one after the other; ends: where each document ends.
    A first round names runs of equal words, further rounds name pairs: a hash of the symbol deals symbols to a
    left and a right class, and a left one followed by a right one becomes one symbol. Names are hashes of what
    they stand for, so they are the same in all tasks. Of a window, the symbols from `low` to `high` are those
    that come out alike whatever surrounds it: a border symbol that might join its unknown neighbour is given
    up, at most one on each side a round. The anchor is the longest symbol left at the highest level that has
    any, then the one of least name, then the first.
    """
    n = len(words)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    sizes = np.maximum(ends - begins - WINDOW + 1, 0)
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(ends) else np.zeros(0, np.int64)
    if not len(starts):
        return Anchors(np.zeros(0, np.uint64), np.zeros(0, np.int64), starts.astype(np.int64), np.zeros(1, np.int64))
    first_word = np.zeros(n + 1, dtype=bool)
    first_word[begins] = True
    # level 1: runs
    opens = first_word[:n].copy()
    opens[0] = True
    opens[1:] |= words[1:] != words[:-1]
    at = np.nonzero(opens)[0]
    span = np.diff(np.append(at, n))
    number = np.cumsum(opens) - 1
    names = mix(words[at] + np.uint64(BASE) * span.astype(np.uint64))
    low, high = number[starts] + 1, number[starts + WINDOW - 1]
    live = np.nonzero(low < high)[0]  # windows that have a symbol at this level
    low, high = low[live], high[live]
    # windows inside one run or two: their first word stands for them
    key, where = mix(words[starts] ^ np.uint64(7)), starts.copy()
    breaks = first_word[at]  # symbols that begin a document

    def choose(which: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> None:
        best = lo.copy()
        best_span, best_name = span[lo], names[lo]
        cur, idx = lo + 1, np.arange(len(lo))
        keep = cur < hi
        cur, idx = cur[keep], idx[keep]
        while len(idx):
            s, m = span[cur], names[cur]
            better = (s > best_span[idx]) | (s == best_span[idx]) & (m < best_name[idx])
            won = idx[better]
            best[won], best_span[won], best_name[won] = cur[better], s[better], m[better]
            cur = cur + 1
            keep = cur < hi[idx]
            cur, idx = cur[keep], idx[keep]
        key[which] = mix(names[best] + np.uint64(level))
        where[which] = at[best]

    for level in range(1, ROUNDS + 1):
        if not len(live):
            break
        right = (mix(names ^ np.uint64(0xA5A5 * level)) & np.uint64(1)).astype(bool)
        joins = ~right[:-1] & right[1:] & ~breaks[1:]
        opens = np.ones(len(names), dtype=bool)
        opens[1:] = ~joins
        number = np.cumsum(opens) - 1
        new_low = number[low] + right[low]
        last = high - 1
        new_high = number[last] + right[last]
        stays = new_low < new_high
        if not stays.all():
            gone = ~stays
            choose(live[gone], low[gone], high[gone], level)
        new_at = at[opens]
        pair = np.nonzero(joins)[0]
        merged = names.copy()
        merged[pair] = mix(names[pair] * np.uint64(3) + mix(names[pair + 1] + np.uint64(level)))
        names, at, breaks = merged[opens], new_at, breaks[opens]
        span = np.diff(np.append(at, n))
        live, low, high = live[stays], new_low[stays], new_high[stays]
    if len(live):
        choose(live, low, high, ROUNDS + 1)
    order = np.lexsort((starts, key, where))
    k, p = key[order], where[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    group = np.nonzero(fresh)[0]
    return Anchors(k[group], p[group], starts[order], np.append(group, len(order)))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "__text", PARSE_BYTES):
        words = read_words(batch.column(0).to_pylist())
        ends = words.bounds
        found = anchors(words.hashes, ends)
        doc = np.searchsorted(ends, found.position, "right")
        begins = np.concatenate([[0], ends[:-1]])
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(found.position - begins[doc])], names=["key", *KEY, "position"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with equal keys that follow one another, the first: a text's copies are read once."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in KEY)
        fresh = np.ones(len(k1), dtype=bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        fresh[0] = before != (k1[0], k2[0])
        before = (k1[-1], k2[-1])
        yield batch if fresh.all() else batch.filter(pa.array(fresh))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For texts with the positions of their repeated anchors: the hashes of the windows these answer for."""
    for batch in chunks(_firsts(batches), "__text", PARSE_BYTES):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        words = read_words(column["__text"].to_pylist())
        ends = words.bounds
        found = anchors(words.hashes, ends)
        begins = np.concatenate([[0], ends[:-1]])
        listed = column["__anchors"]
        doc_of = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
        values = listed.flatten()
        wanted = values.field("position").to_numpy(zero_copy_only=False) + begins[doc_of]
        keys, parts = (values.field(name).to_numpy(zero_copy_only=False) for name in ("key", "parts"))
        # anchors of one position differ in their keys; both sides are put in the same order
        mine = np.lexsort((found.key.view(np.int64), found.position))
        order = np.lexsort((keys, wanted))
        wanted, keys, parts = wanted[order], keys[order], parts[order]
        both = np.concatenate([found.position[mine], wanted]), np.concatenate([found.key[mine].view(np.int64), keys])
        asked = np.concatenate([np.zeros(len(mine), bool), np.ones(len(wanted), bool)])
        ranked = np.lexsort((asked, both[1], both[0]))
        owner = np.maximum.accumulate(np.where(asked[ranked], -1, ranked))  # the anchor just before
        picked = mine[owner[asked[ranked]]]
        if not len(picked):
            continue
        hashes = spans(words.hashes, found.window, found.window + WINDOW).view(np.int64)
        doc = np.searchsorted(ends, found.position[picked], "right")
        k1, k2 = (column[k].to_numpy(zero_copy_only=False)[doc] for k in KEY)

        def rows_of(which: np.ndarray) -> pa.RecordBatch:
            lo, hi = found.bound[picked[which]], found.bound[picked[which] + 1]  # noqa: B023
            offsets = np.concatenate([[0], np.cumsum(hi - lo)])
            take = np.repeat(lo - offsets[:-1], hi - lo) + np.arange(offsets[-1])
            start = found.window[take] - np.repeat(begins[doc[which]], hi - lo)  # noqa: B023
            return _listed(keys[which], k1[which], k2[which], offsets, start, hashes[take])  # noqa: B023

        usual, hot = np.nonzero(parts == 1)[0], np.nonzero(parts > 1)[0]
        if len(usual):
            yield rows_of(usual)
        if len(hot):
            rows = rows_of(hot)
            yield _as_rows(_stretches(rows))
            yield _parted(rows, parts[hot])


def _listed(key: np.ndarray, k1: np.ndarray, k2: np.ndarray, offsets: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Window rows; row i has the starts and hashes from offsets[i] to offsets[i + 1]."""
    size = np.diff(offsets)
    # windows mostly follow one another: then their first start says all
    follows = start[offsets[1:] - 1] - start[offsets[:-1]] == size - 1
    shown = np.where(follows, 1, size)
    places = np.concatenate([[0], np.cumsum(shown)])
    some = np.repeat(offsets[:-1] - places[:-1], shown) + np.arange(places[-1])
    firsts = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(start[some].astype(np.int32)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(k1), pa.array(k2), firsts, lists], names=["key", *KEY, "starts", "hashes"])


def _flat(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and hash of each window of window rows."""
    listed, lists = rows.column(3), rows.column(4)
    flat, firsts = lists.flatten().to_numpy(), listed.flatten().to_numpy().astype(np.int64)
    sizes, begin = np.diff(lists.offsets.to_numpy()), listed.offsets.to_numpy()[:-1] - listed.offsets[0].as_py()
    row = np.repeat(np.arange(rows.num_rows), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    short = (np.diff(listed.offsets.to_numpy()) < sizes)[row]
    return row, firsts[begin[row] + np.where(short, 0, within)] + np.where(short, within, 0), flat


def _parted(rows: pa.RecordBatch, parts: np.ndarray) -> pa.RecordBatch:
    """Of window rows whose anchors have several parts, one place for each window, under keys of the parts: equal windows share a part, by their hash."""
    row, start, hashes = _flat(rows)
    key = rows.column(0).to_numpy()[row]
    order = np.lexsort((hashes, key))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    one = order[fresh]
    row, start, hashes = row[one], start[one], hashes[one]
    part = mix(hashes.view(np.uint64)) % parts[row].astype(np.uint64)
    order = np.lexsort((start, part, row))
    row, part, start, hashes = row[order], part[order], start[order], hashes[order]
    opens = np.ones(len(row), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    first = np.nonzero(opens)[0]
    key, k1, k2 = (rows.column(i).to_numpy()[row[first]] for i in range(3))
    key = mix(key.view(np.uint64) ^ mix(part[first] + np.uint64(BASE))).view(np.int64)
    return _listed(key, k1, k2, np.append(first, len(row)), start, hashes)


def _as_rows(found: pa.RecordBatch) -> pa.RecordBatch:
    """Stretches in the form of window rows, so that both pass the same way; they alone have more starts than hashes."""
    k1, k2, start, length, o1, o2, other = (c.to_numpy() for c in found.columns)
    n = found.num_rows
    firsts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), pa.array(np.stack([start, length, other], 1).ravel().astype(np.int32)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2, pa.int32()), pa.array(np.stack([o1, o2], 1).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k1), pa.array(k2), firsts, lists], names=["key", *KEY, "starts", "hashes"])


def _from_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Undoes _as_rows."""
    numbers, others = rows.column(3).flatten().to_numpy().astype(np.int64).reshape(-1, 3), rows.column(4).flatten().to_numpy().reshape(-1, 2)
    columns = [numbers[:, 0], numbers[:, 1], others[:, 0], others[:, 1], numbers[:, 2]]
    return pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=STRETCH)


STRETCH = [*KEY, "start", "length", *OTHER, "other_start"]


def _stretches(part: pa.RecordBatch) -> pa.RecordBatch:
    """Stretches of window starts whose hash comes at two places or more under its key, each beside another such place.

    That other place is the first of the equal windows by text key and start (the second for the first itself);
    a stretch goes on as long as both sides do.
    """
    row, start, flat = _flat(part)
    k1, k2 = (part.column(i).to_numpy() for i in (1, 2))
    by = np.lexsort((k2, k1))
    text = np.empty(part.num_rows, dtype=np.int64)  # texts numbered in the order of their keys
    text[by] = np.cumsum(np.concatenate([[0], (np.diff(k1[by]) != 0) | (np.diff(k2[by]) != 0)]))
    key = part.column(0).to_numpy()[row]
    order = np.lexsort((start, text[row], flat, key))
    k, h, t, at, r = key[order], flat[order], text[row[order]], start[order], row[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    fresh = opens.copy()
    fresh[1:] |= (t[1:] != t[:-1]) | (at[1:] != at[:-1])
    opens, t, at, r = opens[fresh], t[fresh], at[fresh], r[fresh]
    first = np.nonzero(opens)[0]
    size = np.diff(np.append(first, len(opens)))
    other = np.repeat(first, size)
    other[first] += size > 1
    kept = np.nonzero(np.repeat(size, size) > 1)[0]
    kept = kept[np.lexsort((at[kept], t[kept]))]
    t, at, r, other_t, other_at, other_r = t[kept], at[kept], r[kept], t[other[kept]], at[other[kept]], r[other[kept]]
    opens = np.ones(len(kept), dtype=bool)
    opens[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1) | (other_t[1:] != other_t[:-1]) | (other_at[1:] != other_at[:-1] + 1)
    first = np.nonzero(opens)[0]
    length = np.diff(np.append(first, len(kept)))
    columns = [k1[r[first]], k2[r[first]], at[first], length, k1[other_r[first]], k2[other_r[first]], other_at[first]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=STRETCH)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches from window rows sorted by key."""
    held: list[pa.RecordBatch] = []
    try:
        for batch in batches:
            done = pc.greater(pc.list_value_length(batch.column(3)), pc.list_value_length(batch.column(4)))
            if (made := batch.filter(done)).num_rows:
                yield _from_rows(made)
            batch = batch.filter(pc.invert(done))
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            if cut:
                yield _stretches(_joined([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(0)[0].as_py() != keys[0]:
                yield _stretches(_joined(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _stretches(_joined(held))
    finally:
        release_memory()


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class _Text:
    """A text's words and the bytes of any stretch of them."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.line = b" ".join(self.words)
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)) + 1)])

    def digests(self, starts: list[int], lengths: list[int]) -> list[bytes]:
        """128-bit digests of the words in each stretch of windows."""
        begin, line = self.begin, self.line
        return [blake2b(line[begin[s] : begin[s + n - 1 + WINDOW] - 1], digest_size=16).digest() for s, n in zip(starts, lengths)]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the stretches that others are to be compared with."""
    for batch in chunks(_firsts(batches), "__text", PARSE_BYTES):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        asked = column["__asked"]
        starts, lengths = (asked.flatten().field(i) for i in ("start", "length"))
        digests: list[bytes] = []
        bounds = asked.offsets.to_numpy() - asked.offsets[0].as_py()
        a, b = starts.to_pylist(), lengths.to_pylist()
        for i, text in enumerate(column["__text"].to_pylist()):
            digests += _Text(text).digests(a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]])
        index = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
        yield pa.RecordBatch.from_arrays([*[column[k].take(index) for k in KEY], starts, lengths, pa.array(digests, pa.binary())], names=[*OTHER, "other_start", "length", "digest"])


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words in any window of the stretches."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths - 1 + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_removed (long) and kept_text to every row.

    Words stand between ASCII white space and are compared unchanged. Every word in a window of WINDOW
    words whose words also start anywhere else, in this text or another, is removed; windows are judged on
    the input. Null and shorter texts lose nothing. A repeated row is another place, so a text of WINDOW words
    or more that comes twice loses all its words. An empty table gives no rows; other columns pass through.

    Texts are known by 128 bits of their SHA-256, so that copies are read once and cost no more than their rows. Anchors go
    through Spark first: only those that come twice can belong to a repeat. Windows under them are then compared
    by their hashes, in tasks that hold one anchor's rows at a time (at most HOT). The windows of a more frequent
    anchor are compared among the texts that a task reads together first; one place of each then goes on, in as many
    parts by hash as HOT goes into the anchor's places. In the end each repeated stretch is compared with
    the other place it was found at, by a cryptographic digest of the words there; one that differs stays.
    """
    docs, unpack = pack_columns(docs, text_col)
    source = text_as_bytes(docs, text_col)
    names = source.columns
    source = with_text_key(source, F.col("__text"))
    long_key = "__k1 long, __k2 long"

    def of_texts(lists: DataFrame, how: str = "inner") -> DataFrame:
        """Rows beside what is known of their text; all columns, so that the texts are dealt out once for all uses."""
        own = dealt_anew(lists, {"__k1": "__j1", "__k2": "__j2"})
        return source.join(own, (source["__k1"] == own["__j1"]) & (source["__k2"] == own["__j2"]), how)

    found = written(source.select("__text", *KEY).mapInArrow(_anchor_rows, f"key long, {long_key}, position long"))
    counted = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counted = dealt_anew(counted, {"key": "__key"})
    parts = F.ceil(F.col("n") / HOT).cast("int")
    repeated = found.join(counted, found["key"] == counted["__key"]).select(*KEY, F.struct("position", "key", parts.alias("parts")).alias("a"))
    listed = repeated.groupBy(*KEY).agg(F.collect_set("a").alias("__anchors"))  # of one text, bounded by its words
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = of_texts(listed).mapInArrow(_window_rows, f"key long, {long_key}, starts array<int>, hashes array<long>")
    windows = windows.repartition(spread, "key").sortWithinPartitions("key")
    places = windows.mapInArrow(_repeated, f"{long_key}, start long, length long, __o1 long, __o2 long, other_start long")

    asked = places.select(F.col("__o1").alias("__k1"), F.col("__o2").alias("__k2"), F.struct(F.col("other_start").alias("start"), "length").alias("a"))
    asked = asked.groupBy(*KEY).agg(F.collect_set("a").alias("__asked"))
    digests = of_texts(asked).mapInArrow(_digest_rows, "__o1 long, __o2 long, other_start long, length long, digest binary")
    # one row even where the copies of a text were read by several tasks
    span = [*OTHER, "other_start", "length"]
    digests = dealt_anew(digests.dropDuplicates(span), {c: f"{c}_" for c in span})
    checks = places.join(digests, [places[c] == digests[f"{c}_"] for c in span]).select(*KEY, F.struct("start", "length", "digest").alias("s"), F.lit(0).alias("copies"))
    copies = source.groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1")
    ruled = checks.unionByName(copies.select(*KEY, F.lit(None).cast(checks.schema["s"].dataType).alias("s"), F.lit(1).alias("copies")))
    ruled = ruled.groupBy(*KEY).agg(F.collect_list("s").alias("__stretches"), (F.max("copies") > 0).alias("__copied"))
    joined = of_texts(ruled, "left")
    out_schema = source.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", PARSE_BYTES):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name.startswith("__")}
            rows = []
            for value, listed, copied in zip(column["__text"].to_pylist(), column["__stretches"], column["__copied"].to_pylist()):
                if copied and len(words := value.split()) >= WINDOW:
                    rows.append((len(words), len(words), ""))
                elif listed.is_valid and len(listed.values):
                    held = _Text(value)
                    starts, lengths = (listed.values.field(i).to_numpy() for i in range(2))
                    same = [a == b for a, b in zip(held.digests(starts.tolist(), lengths.tolist()), listed.values.field(2).to_pylist())]
                    gone = _cover(len(held.words), starts[same], lengths[same])
                    rows.append((len(held.words), int(gone.sum()), b" ".join(compress(held.words, (~gone).tolist())).decode()))
                else:
                    words = value.split()
                    rows.append((len(words), 0, b" ".join(words).decode()))
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *made], names=[*names, "n_words", "n_removed", "kept_text"])

    return unpack(text_back(joined.mapInArrow(remove, out_schema), text_col, *docs.columns, "n_words", "n_removed", "kept_text"))


def op7_recompression(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
