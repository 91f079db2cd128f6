"""Benchmark decontamination with a stored positional inverted index of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Words, chunks, dealt_anew, pack_columns, read_words, release_memory, small_batches, with_text_key, written

WINDOW = 10
#: Positions by which a term may stray in a proximity match, and the rarest terms of a window that must be met.
SLOP = 2
PROXIMITY_TERMS = 4
#: Bytes of text that share one block of the index.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text taken at a time, whose plan (about 65 bytes a word) is broadcast; a larger benchmark comes in slices.
SLICE_BYTES = 4 << 20
#: Positions that are intersected at a time in a task.
CANDIDATES = 1 << 18
#: Places between two documents of a block, so that no window reaches from one into the next.
GAP = 64
#: Bits of a position in a key of term and position.
PLACE_BITS = 33

#: A-Z to a-z; every other ASCII character that is no letter or digit to a space. Bytes from 0x80 up are word characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
KEY = ["__k1", "__k2"]
INDEX = "k1 array<long>, k2 array<long>, lengths array<int>, vocabulary binary, counts binary, sizes binary, postings binary"
SPANS = "array<struct<start:bigint,end:bigint>>"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 in bytes of seven bits each, the eighth saying that more follow; and how many bytes each takes."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), dtype=np.int64)
    for k in range(1, 5):
        n += v >= np.uint64(1 << 7 * k)
    begin = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[begin[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n[some] > k + 1).astype(np.uint8) << 7)
    return out, n


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.nonzero(data < 128)[0]
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    n = ends - begin + 1
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[some] |= (data[begin[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of stretches, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _index_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the index, one for each range of documents: its documents' keys and lengths, and the posting list of every term.

    Terms stand in the order of their hashes, as words; lists are differences of positions. `counts` has the
    entries and `sizes` the bytes of each list.
    """
    for batch in chunks(batches, "__text", limit):
        words = read_words([t.translate(_TABLE) for t in batch.column(0).to_pylist()])
        lengths = np.diff(words.bounds, prepend=0)
        position = np.arange(len(words.hashes)) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
        order = np.argsort(words.hashes, kind="stable")
        h, p = words.hashes[order], position[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = h[1:] != h[:-1]
        first = np.nonzero(fresh)[0]
        step = np.diff(p, prepend=0)
        step[first] = p[first]
        data, n = packed(step)
        begin, end = words.starts[order[first]], words.ends[order[first]]
        # words and the white space after each
        vocabulary = words.data[_stretches(begin, end - begin + 1)] if len(first) else np.zeros(0, np.uint8)
        blobs = [vocabulary.tobytes(), packed(np.diff(np.append(first, len(h))))[0].tobytes(), packed(np.add.reduceat(n, first) if len(first) else n)[0].tobytes(), data.tobytes()]
        whole = pa.array([0, len(lengths)], pa.int32())
        listed = [pa.ListArray.from_arrays(whole, x) for x in (batch.column(1), batch.column(2), pa.array(lengths, pa.int32()))]
        yield pa.RecordBatch.from_arrays([*listed, *[pa.array([x], pa.binary()) for x in blobs]], names=["k1", "k2", "lengths", "vocabulary", "counts", "sizes", "postings"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of rows (__text, __k1, __k2): positional postings of every token, in blocks of documents.

    It is written to the shared folder as Parquet; terms and counts are read without the postings.
    """
    limit = SHARD_BYTES
    return written(docs.select("__text", *KEY).mapInArrow(lambda batches: _index_rows(batches, limit), INDEX))


@dataclass(frozen=True)
class Terms:
    """A slice of the benchmark: its terms in the order of their hashes, and its items as term numbers."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    names: list[str | None]
    name: np.ndarray  # of each item, a number in `names`
    ids: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes]]) -> Terms:
        words = read_words([t.translate(_TABLE) for _, t in rows])
        hashes, first, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
        names = list(dict.fromkeys(name for name, _ in rows))
        number = {name: i for i, name in enumerate(names)}
        return cls(words.data, words.starts[first], words.ends[first], hashes, names, np.array([number[name] for name, _ in rows], dtype=np.int64), ids.astype(np.int64), words.bounds)

    def among(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers that `words` (in the order of hashes) has, and their places there; the words themselves are compared."""
        if not len(words.hashes) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words.hashes, self.hashes), len(words.hashes) - 1)
        size = self.ends - self.starts
        term = np.nonzero((words.hashes[at] == self.hashes) & (words.ends[at] - words.starts[at] == size))[0]
        if not len(term):
            return term, term
        size = size[term]
        differs = words.data[_stretches(words.starts[at[term]], size)] != self.data[_stretches(self.starts[term], size)]
        term = term[np.add.reduceat(differs, np.cumsum(size) - size) == 0]
        return term, at[term]


@dataclass(frozen=True)
class Plan:
    """Distinct windows with their terms from the rarest up, and the names of the items that hold each.

    `at` has positions in the window, `term` the term numbers there; a short item repeats its rarest term.
    """

    terms: Terms
    length: np.ndarray
    at: np.ndarray
    term: np.ndarray
    holders: np.ndarray  # names, grouped by window
    bounds: np.ndarray

    @classmethod
    def of(cls, terms: Terms, counts: np.ndarray, window: int) -> Plan:
        begin = np.concatenate([[0], terms.bounds[:-1]]).astype(np.int64)
        size = terms.bounds - begin
        n = np.where(size > 0, np.maximum(size - window + 1, 1), 0)  # windows of each item
        item = np.repeat(np.arange(len(n)), n)
        start = _stretches(begin, n)
        place = np.arange(window)
        inside = place < size[item][:, None]
        rows = np.where(inside, terms.ids[np.minimum(start[:, None] + place, max(len(terms.ids) - 1, 0))] if len(terms.ids) else -1, -1)
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([which.ravel(), terms.name[item]]), axis=0)
        order = np.argsort(np.where(rows >= 0, np.append(counts, 0)[rows], np.iinfo(np.int64).max), axis=1, kind="stable")
        term = np.take_along_axis(rows, order, axis=1)
        none = term < 0
        at = np.where(none, order[:, :1], order)
        term = np.where(none, term[:, :1], term)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        return cls(terms, (rows >= 0).sum(axis=1), at.astype(np.int16), term.astype(np.int32), pairs[:, 1], bounds)


class Lists:
    """Posting lists of a slice's terms in one block, as sorted keys of term and position."""

    def __init__(self, terms: Terms, vocabulary: bytes, counts: bytes, sizes: bytes, postings: bytes):
        own = read_words([vocabulary])
        term, at = terms.among(own)
        n, size = (unpacked(np.frombuffer(x, np.uint8)) for x in (counts, sizes))
        begin = np.cumsum(size) - size
        steps = unpacked(np.frombuffer(postings, np.uint8)[_stretches(begin[at], size[at])])
        n = n[at]
        sums = np.cumsum(steps)
        before = np.concatenate([[0], sums])[np.cumsum(n) - n]
        self.keys = (np.repeat(term, n) << PLACE_BITS) + sums - np.repeat(before, n)

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the terms' lists among the keys."""
        term = term.astype(np.int64)
        return np.searchsorted(self.keys, term << PLACE_BITS), np.searchsorted(self.keys, (term + 1) << PLACE_BITS)

    def meets(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """How far the nearest entry of each term's list is from a place: 0, 1 within slop, or 2."""
        key = (term.astype(np.int64) << PLACE_BITS) + place
        if not len(self.keys):
            return np.full(len(key), 2)
        near = self.keys[np.minimum(np.searchsorted(self.keys, key - slop), len(self.keys) - 1)]
        within = (near >= key - slop) & (near <= key + slop)
        if not slop:
            return np.where(within, 0, 2)
        exact = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return np.where(exact, 0, np.where(within, 1, 2))


def match(lists: Lists, plan: Plan, slop: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Matches as (window, position of its rarest term, position where it starts, whether the phrase is exact), some at a time.

    Each window starts from the list of its rarest term; the lists of its other terms, from the rarest on, are
    moved by their offsets and intersected with what is left. With `slop`, starts whose PROXIMITY_TERMS rarest
    terms each lie within that many positions of their place are proximity matches.
    """
    if not len(plan.length):
        return
    low, high = lists.of(plan.term[:, 0])
    reach = np.concatenate([[0], np.cumsum(high - low)])
    total = int(reach[-1])
    for begin in range(0, total, at_once):
        number = np.arange(begin, min(begin + at_once, total))
        w = np.searchsorted(reach, number, "right") - 1
        anchor = lists.keys[low[w] + number - reach[w]] & ((1 << PLACE_BITS) - 1)
        start = anchor - plan.at[w, 0]
        exact = np.ones(len(w), dtype=bool)
        live = np.arange(len(w))
        for j in range(1, plan.at.shape[1]):
            wide = slop if j < PROXIMITY_TERMS else 0
            far = lists.meets(plan.term[w[live], j], start[live] + plan.at[w[live], j], wide)
            exact[live[far > 0]] = False
            # past the terms that count for proximity, inexact starts wait in the end result
            live = live[far < 2] if slop and j < PROXIMITY_TERMS else live[exact[live]]
            if slop and j == PROXIMITY_TERMS - 1:
                close, live = live, live[exact[live]]
        if slop:
            kept = close if plan.at.shape[1] >= PROXIMITY_TERMS else live
        else:
            kept = live
        yield w[kept], anchor[kept], start[kept], exact[kept]


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the stretches where more intervals have begun than ended."""
    inside = np.cumsum(cover) > 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def _span_lists(doc: np.ndarray, start: np.ndarray, end: np.ndarray, docs: int) -> pa.ListArray:
    bounds = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"]))


def _found_in_block(plan: Plan, slop: int, at_once: int, k1: pa.Array, k2: pa.Array, lengths: np.ndarray, blobs: list[bytes], every: bool) -> pa.RecordBatch:
    """For the documents of one block, all or those with matches: length, exact and near spans, and items; folded as they come."""
    lists, docs = Lists(plan.terms, *blobs), len(lengths)
    base = np.cumsum(lengths) - lengths + np.arange(docs) * GAP  # where each document begins
    size = int(base[-1] + lengths[-1]) if docs else 0
    covers = np.zeros((2, size + 1), dtype=np.int64)
    n_near = np.zeros(docs, dtype=np.int64)
    pairs = np.zeros(0, dtype=np.int64)
    for w, anchor, start, exact in match(lists, plan, slop, at_once):
        doc = np.searchsorted(base, anchor, "right") - 1
        begin, end = np.maximum(start, base[doc]), np.minimum(start + plan.length[w], base[doc] + lengths[doc])
        for cover, some in zip(covers, (exact, ~exact)):
            np.add.at(cover, begin[some], 1)
            np.add.at(cover, end[some], -1)
        n_near += np.bincount(doc[~exact], minlength=docs)
        pairs = np.union1d(pairs, doc[exact] * len(plan.length) + w[exact])
    columns = []
    for cover in covers:
        begin, end = _runs(cover)
        doc = np.searchsorted(base, begin, "right") - 1
        columns.append(_span_lists(doc, begin - base[doc], end - base[doc], docs))
    doc, w = np.divmod(pairs, max(len(plan.length), 1))
    n = plan.bounds[w + 1] - plan.bounds[w]
    held = np.unique(np.repeat(doc, n) * max(len(plan.terms.names), 1) + plan.holders[_stretches(plan.bounds[w], n)])
    doc, name = np.divmod(held, max(len(plan.terms.names), 1))
    names = pa.array(plan.terms.names, pa.string()).take(pa.array(name))
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)), names)
    out = pa.RecordBatch.from_arrays([k1, k2, pa.array(lengths, pa.int64()), columns[0], items, columns[1], pa.array(n_near)], names=[*KEY, "n_words", "matches", "items", "near", "n_near"])
    if every:
        return out
    return out.filter(pa.array((n_near > 0) | (np.diff(out.column(3).offsets.to_numpy()) > 0)))


def _counts(index: DataFrame, terms: Terms) -> np.ndarray:
    """Occurrences of each term of the slice in all documents, from the index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        counts = np.zeros(len(terms.hashes), dtype=np.int64)
        for batch in batches:
            for vocabulary, packed_counts in zip(*(batch.column(i).to_pylist() for i in range(2))):
                term, at = terms.among(read_words([vocabulary]))
                counts[term] += unpacked(np.frombuffer(packed_counts, np.uint8))[at]
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])
        release_memory()

    out = np.zeros(len(terms.hashes), dtype=np.int64)
    rows = index.select("vocabulary", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in rows.collect():  # at most one row for each term of the slice
        out[term] = n
    return out


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (__k1, __k2, n_words, matches, items, near, n_near), one for each distinct text of the index.

    The benchmark comes in slices of about SLICE_BYTES, each with one pass over terms and counts and one over the
    postings; documents aren't read again. What a text has in several slices is put together in the end.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-total // SLICE_BYTES) or 1
    found, at_once = None, CANDIDATES
    for number in range(slices):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == number) if slices > 1 else items
        terms = Terms.of([(i, bytes(t)) for i, t in own.collect()])  # bounded by the slice
        shared = index.sparkSession.sparkContext.broadcast(Plan.of(terms, _counts(index, terms), window))

        def run(batches, shared=shared, every=number == 0):
            for batch in batches:
                for i in range(batch.num_rows):
                    k1, k2, lengths = (batch.column(c)[i].values for c in range(3))
                    yield _found_in_block(shared.value, slop, at_once, k1, k2, lengths.to_numpy().astype(np.int64), [batch.column(c)[i].as_py() for c in range(3, 7)], every)
            release_memory()

        # copies of a text have equal rows
        rows = index.mapInArrow(run, f"__k1 long, __k2 long, n_words long, matches {SPANS}, items array<string>, near {SPANS}, n_near long").dropDuplicates(KEY)
        found = rows if found is None else found.unionByName(rows)
    if slices > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("matches", "items", "near")]  # of one text, from each slice
        found = found.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), *lists, F.sum("n_near").alias("n_near"))
        found = found.withColumns({"items": F.array_distinct("items"), "matches": _merged("matches"), "near": _merged("near")})
    return found


def _merged(spans: str):
    """Spans of several slices as sorted spans that neither overlap nor touch."""
    none = F.array().cast(SPANS)

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(done).cast("int") == 0, F.array(x)).when(x["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Adds n_words (long), matches (array of start, end), items (array of string), near (array of start, end) and n_near (long) to every document.

    Start and end are word positions, ends exclusive. `matches` are the stretches covered by occurrences of windows
    of `window` consecutive item words (the whole item where it is shorter), `items` the items that have such an
    occurrence; `near` are the stretches of the n_near proximity matches that are not exact. Null text has no words;
    an item without words has no windows; items of one id count as that id, and items of null id as one more, with
    a null in `items`. Repeated rows are matched as often as they come. Empty tables give rows without matches,
    or no rows; other columns pass through.

    The documents' index is built and stored first, then searched (see `search`). A window that many items share is
    searched once, and occurrences are folded into stretches as they are found, so neither frequent windows nor
    repetitive texts make lists longer than the text.
    """
    if window + slop >= GAP:
        raise ValueError(f"windows must be shorter than {GAP} words with their slop")
    docs, unpack = pack_columns(small_batches(docs), text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    source = with_text_key(docs, text)
    index = build_index(source.select(text.alias("__text"), *KEY))
    found = dealt_anew(search(index, benchmark, window, slop, item_col, item_text_col), {"__k1": "__j1", "__k2": "__j2"})
    joined = source.join(found, (source["__k1"] == found["__j1"]) & (source["__k2"] == found["__j2"]), "left")
    return unpack(joined.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", "matches", "items", "near", "n_near"))


def with_digest(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256, contaminated, n_proximity to the result of find_contamination.

    Matches of items of null id count everywhere but in items_sha256, which lists ids.
    """
    hit = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    found = found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "n_proximity": F.col("n_near")})
    return found.withColumns({"items_sha256": F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256), "contaminated": F.col("n_hit") > 0})


def op8_positional_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_digest(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_proximity")
