"""Hard negatives, resampling and host rules against brute force, with the edge cases that each docstring defines."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import hard_negatives, host_rules, resampling

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank double, block int, anchor string"


def vectors(rng, n, dims, spread=1.0):
    return [(i, [rng.gauss(0, spread) / math.sqrt(dims) for _ in range(dims)], rng.randrange(4), "x", 0.0, 1, "y") for i in range(n)]


def brute_negatives(rows, every, positives=5, negatives=3, window=(50, 95)):
    """Rows (anchor, positive, rank, negative, scores) by all products; rows are (id, vector, label)."""
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    codes = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in seen.items()}
    score = lambda a, b: sum(x * y for x, y in zip(codes[a][1], codes[b][1]))
    out = []
    for a in codes:
        if a % every:
            continue
        order = sorted((-score(a, b), b) for b in codes if b != a)
        for p_score, p in [x for x in order if codes[x[1]][0] == codes[a][0]][:positives]:
            inside = [x for x in order if codes[x[1]][0] != codes[a][0] and window[0] * -p_score <= 100 * -x[0] <= window[1] * -p_score]
            out += [(a, p, rank, n, -p_score, -s) for rank, (s, n) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, every, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize(("dims", "block"), [(16, 64), (7, 50), (1, 4096)])
def test_hard_negatives(spark, monkeypatch, dims, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rows = vectors(random.Random(dims), 400, dims)
    found = mined(spark.createDataFrame(rows, VECTORS).repartition(3), 10)
    assert found == brute_negatives([r[:3] for r in rows], 10) and found


def test_hard_negatives_of_ties_repeats_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rng = random.Random(5)
    rows = [r[:3] for r in vectors(rng, 120, 4)]
    same = [0.5, 0.5, 0.5, 0.5]
    rows += [(200 + i, same, i % 2) for i in range(60)]  # ties
    rows += [(200, same, 0)] * 40 + [(210, [0.1, 0.2, 0.3, 0.4], 0), (210, same, 1)]  # repeats, and one id with two vectors
    rows += [(300, [0.4, None, 0.1, 0.2], 1), (310, None, 1), (320, same, None), (None, same, 1), (330, [float("nan"), 0.0, 0.0, 0.0], 1), (340, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(350, [], 1), (360, [0.9], 2), (370, [-0.9, -0.9, -0.9, -0.9], 3), (380, [0.9, 0.9, 0.9, 0.9, 0.9, 0.9], 3)]
    # what a shorter vector lacks is zero, and floor(256 * 0) is 0
    rng.shuffle(rows)
    found = mined(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4), 10)
    assert found == brute_negatives([(i, v if v is None else [float(np.float32(x)) if x is not None else None for x in v], label) for i, v, label in rows], 10)


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    empty = spark.createDataFrame([], schema)
    assert mined(empty, 5) == []
    assert hard_negatives.hard_negatives(empty, F.col("label"), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark.createDataFrame([(0, [1.0], 1)], schema), 5) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], schema), 5) == []  # a single label
    with pytest.raises(Exception, match="long"):
        mined(spark.createDataFrame([(0, [1e9], 1), (5, [1e9], 1)], schema), 5)


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(3)
    codes = hard_negatives.codes_of(list(rng.normal(0, 0.125, (3000, 64))))
    cells, low, high = hard_negatives.approximate(codes)
    record = {"ids": np.arange(3000).tobytes(), "labels": np.zeros(3000, dtype=np.int64).tobytes(), "dims": 64, "codes": codes.tobytes(), "width": 8, "anchor": None, "wanted": None}
    block = hard_negatives.Block(record | {"cells": cells.tobytes(), "low": low.tobytes(), "high": high.tobytes()})
    possible = 0
    for code in codes[:20]:
        least, greatest = block.bounds(code, slice(0, 3000))
        exact = codes @ code
        assert (least <= exact).all() and (exact <= greatest).all()
        possible += (greatest >= np.sort(least)[-6]).sum()
    assert possible < 0.05 * 20 * 3000  # the file leaves few vectors to be scored


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_resample(docs, target, longest, buckets, min_words, percent):
    def features(text):
        w = WORDS.findall(lowered(text))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1))

    raw, wanted = [(i, *features(t)) for i, t in docs], sum((features(t)[1] for t in target), Counter())
    s = sum((c for _, _, c in raw), Counter())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (wanted.total() + buckets))))
    rows = []
    for i, n, c in raw:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * k for b, k in c.items())
        rows.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "naïve", "x1", "Ünder", "日本", "a-b", "c_d", "e\x00f"]
    return [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 25, 60, 400])))) for i in range(n)]


@pytest.mark.parametrize(("longest", "chunk"), [(1, 1 << 16), (1, 64), (3, 64), (2, 5)])
def test_resampling(spark, longest, chunk):
    docs = texts(80, 2) + [(90, None), (91, ""), (92, "z" * 500), (None, "alpha beta " * 30), (5, "alpha " * 40)]
    docs += [docs[0], docs[0], (93, "Beta gamma " * 300), (93, "Beta gamma " * 300)]  # repeated rows, short and cut
    target = [t for _, t in texts(10, 3)] + [None]
    df = spark.createDataFrame([(i, t, 1, "a", 2.0) for i, t in docs], "doc_id long, text string, n_words int, rank string, __k1 double").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.importance_resample(df, wanted, longest=longest, buckets=50, percent=30, chunk=chunk)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got, want = sorted(map(tuple, found.collect()), key=str), brute_resample(docs, target, longest, 50, 20, 30)
    strip = lambda rows: sorted((tuple(r[:5]) for r in rows), key=str)
    assert strip(got) == strip(want)
    ranked = lambda rows: [r[:5] for r in sorted((r for r in rows if r[5]), key=lambda r: r[5])]
    assert ranked(got) == ranked(want) and sorted(r[5] for r in got if r[5]) == list(range(1, len(ranked(want)) + 1))


@pytest.mark.parametrize(("longest", "size"), [(1, 7), (3, 7), (4, 1)])
def test_chunks_own_every_start_once(longest, size):
    text = " ".join(t for _, t in texts(30, 9)).encode().lower()
    known = resampling.Buckets(1 << 30)
    whole = known.of(text, len(text), longest)
    parts = [known.of(piece, own, longest) for piece, own in resampling.cut(text, longest - 1, size)]
    assert len(parts) > 5 and sum(n for n, _ in parts) == whole[0]
    assert sorted(np.concatenate([b for _, b in parts]).tolist()) == sorted(whole[1].tolist())


def test_resampling_edges(spark):
    schema, target = "doc_id long, text string", spark.createDataFrame([], "text string")
    assert resampling.importance_resample(spark.createDataFrame([], schema), target).count() == 0
    rows = resampling.importance_resample(spark.createDataFrame([(1, None), (2, "a b")], schema), target).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in rows) == [(1, 0, None), (2, 2, None)]
    same = resampling.importance_resample(spark.createDataFrame([(None, "a " * 30)] * 20, schema), target).collect()
    assert sorted(r["rank"] for r in same if r["rank"]) == [1, 2]  # ties among rows alike


SPACE = "[\x20\x09-\x0d]+"


def brute_measures(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def host_texts(seed=4):
    rng = random.Random(seed)
    out = [(0, "a", None), (1, "a", ""), (2, None, " \n\t"), (3, None, "x y x y x y x"), (4, "b", "a b c\na b c\n\n \na b c"), (5, "b", "é" * 60), (6, "c", "\x0b\x0c\r#$   x")]
    for i in range(10, 160):
        words = [rng.choice("abcdefgh") if i % 3 else f"w{rng.randrange(4000)}" for _ in range(rng.choice([10, 49, 50, 51, 120, 300]))]
        text = rng.choice([" ", "\n", " \t", " # "]).join(words)
        out.append((i, f"h{i % 7}", text + ("\n" + text if i % 11 == 0 else "")))
    return out


def test_host_rules(spark):
    rows = host_texts()
    df = spark.createDataFrame([(*r, 1, "z", 0.5) for r in rows], "doc_id long, source string, text string, n_words int, kept string, __w double").repartition(3)
    found = {r["doc_id"]: r for r in host_rules.host_rules(df).collect()}
    assert len(found) == len(rows)
    for i, _, text in rows:
        r, want = found[i], brute_measures(text)
        assert tuple(r[c] for c in host_rules.MEASURES) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash of one value every window is a candidate; the words decide."""
    monkeypatch.setattr(host_rules.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    texts_ = [t for _, _, t in host_texts() if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string")
    for r in host_rules.measured(df, "t").collect():
        assert r["n_repeat_words"] == brute_measures(texts_[r["i"]])[4]


def test_host_rates_are_shrunk(spark):
    """A large failing host is rejected; a small one with the same share of failures is not; a single host meets the default prior."""
    bad, good = "short", " ".join(f"w{i}" for i in range(60))
    rows = [("bad", bad)] * 95 + [("bad", good)] * 5 + [("small", bad)] * 1 + [(f"good{i % 9}", good) for i in range(900)] + [(None, good)] * 30
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    found = host_rules.host_rules(df).collect()
    assert len(found) == len(rows)
    by = defaultdict(set)
    for r in found:
        by[rows[r["doc_id"]][0]].add((r["base_failed"], r["host_failed"], r["kept"]))
    assert by["bad"] == {(True, True, False), (False, True, False)} and by["small"] == {(True, False, False)}
    assert by[None] == by["good0"] == {(False, False, True)}
    measures = host_rules.measured(df.withColumn("t", F.coalesce("text", F.lit(""))), "t")
    rates = {r["host"]: r for r in host_rules.host_verdicts(measures, "source", host_rules.rules()).collect()}
    assert rates["bad"]["n"] == 100 and 0.8 < rates["bad"]["rate_words"] < 0.95 and 0 < rates["small"]["rate_words"] < 0.8
    assert all(r["rate_lines"] == 0 for r in rates.values())


def test_host_prior_follows_the_moments(spark):
    rng = random.Random(1)
    counts = [(f"h{i}", n := rng.randint(5, 400), sum(rng.random() < p for _ in range(n))) for i, p in ((i, rng.betavariate(2, 6)) for i in range(60))]
    rows = [(h, k < f) for h, n, f in counts for k in range(n)]
    df = spark.createDataFrame(rows, "h string, bad boolean")
    got = {r["host"]: r["rate_x"] for r in host_rules.host_verdicts(df, "h", {"x": F.col("bad")}).collect()}
    total = sum(n for _, n, _ in counts)
    mean = sum(f for *_, f in counts) / total
    chance = (len(counts) - 1) / total
    apart = 1 - sum(n * n for _, n, _ in counts) / total**2 - chance
    alike = sum(n * (f / n - mean) ** 2 for _, n, f in counts) / total / (mean * (1 - mean)) - chance
    strength = apart / alike - 1
    assert 3 < strength < 20  # the rates were drawn with a strength of 8
    for h, n, f in counts:
        assert got[h] == pytest.approx((mean * strength + f) / (strength + n))


def test_host_rules_edges(spark):
    schema = "doc_id long, source string, text string"
    assert host_rules.host_rules(spark.createDataFrame([], schema)).count() == 0
    rows = host_rules.host_rules(spark.createDataFrame([(None, None, None)] * 3 + [(1, "a", "b " * 200_000)], schema)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_repeat_words"], r["kept"]) for r in rows) == [("1", 200_000, 200_000, False)] + [("None", 0, 0, False)] * 3
