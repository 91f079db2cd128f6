"""Streams against plain replays, across restarts: resampling, demultiplexing, balance and resumed scoring."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from loomspark.operators import balance as BA
from loomspark.operators import demux as DX
from loomspark.operators import scorers as C
from loomspark.streaming import demux as SD
from loomspark.streaming import scores as ST


def drain(stream, name, checkpoint=None):
    """Runs a stream to its present end and gives the rows, in order, that the memory table has then."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", str(checkpoint))
    q = writer.start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return stream.sparkSession.table(name).collect(), progress


# ------------------------------------------------------------------ resampling


def test_draws_go_on_after_a_restart(spark, tmp_path):
    keys = spark.createDataFrame([(f"shard{i}",) for i in range(7)], "shard string")

    def run():
        stream = ST.resampled(spark, keys, "shard", size=20, seed="s", blocks=2)
        assert stream.isStreaming
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.draw, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    again = run()
    n, m = len(first), len(again)
    assert n >= 40 and m > n and again[:n] == first and [d for d, _ in again] == list(range(m))
    bounded = sorted((r.draw, r.shard) for r in ST.resampled_batch(spark, keys, "shard", m, "s").collect())
    assert again == bounded and len({s for _, s in again}) == 7


def test_draws_fall_evenly(spark):
    drawn = Counter(r.id for r in ST.resampled_batch(spark, spark.range(20), "id", 4000).collect())
    assert sum(drawn.values()) == 4000 and len(drawn) == 20 and 140 < min(drawn.values()) and max(drawn.values()) < 260
    assert ST.resampled_batch(spark, spark.range(0), "id", 10).count() == 0


# ------------------------------------------------------------------ demultiplexer


def replay(items, classes, per_class, buffer):
    """Children pull in turn: (item, child, handed over) in the order of answers, and what stays parked."""
    source, parked, out, most = iter(items), [deque() for _ in range(classes)], [], 0
    asking = 0
    while True:
        if parked[asking]:
            out.append((parked[asking].popleft(), asking, False))
        else:
            for kind, item in source:
                if kind == asking:
                    out.append((item, asking, False))
                    break
                parked[kind].append(item)
                used = sum(map(len, parked))
                most = max(most, used)
                if used > per_class * classes or used > 0.75 * buffer:
                    largest = max(range(classes), key=lambda k: (len(parked[k]), -k))
                    out.append((parked[largest].popleft(), asking, largest != asking))
                    break
            else:
                return out, parked, most, asking
        asking = (asking + 1) % classes


def items(n, seed, shares=(6, 3, 1)):
    rng = random.Random(seed)
    return [(rng.choices(range(len(shares)), shares)[0], i) for i in range(n)]


@pytest.mark.parametrize(("per_class", "buffer"), [(2, 1000), (50, 1000), (50, 20)])
def test_demux_answers_like_pulling_children(per_class, buffer):
    own = items(900, 1)
    demux, got, most = DX.Demux(3, per_class, buffer), [], 0
    for kind, item in own:
        got += [(i, child, handed) for i, child, _, handed in demux.feed(kind, item)]
        most = max(most, demux.usage)
        assert demux.usage == sum(map(len, demux.parked))
    want, parked, _, asking = replay(own, 3, per_class, buffer)
    assert got == want and [list(p) for p in demux.parked] == [list(p) for p in parked] and demux.asking == asking
    assert most <= min(per_class * 3, 0.75 * buffer) + 1 and any(h for *_, h in got)
    rest = [i for i, *_ in demux.flush()]
    assert sorted(rest) == sorted(i for p in parked for i in p) and demux.usage == 0


def test_demux_limits():
    full = DX.Demux(2, per_class=None, buffer=10)
    with pytest.raises(BufferError, match="over 10"):
        for i in range(12):
            list(full.feed(1, i))
    for bad in (-1, 2):
        with pytest.raises(ValueError, match="out of range"):
            list(DX.Demux(2).feed(bad, 0))
    assert list(DX.Demux(2).feed(None, 0)) == []
    with pytest.raises(ValueError):
        list(DX.Demux(2, drop_none=False).feed(None, 0))
    with pytest.raises(ValueError):
        DX.Demux(0)


def grouped(n=400, groups=3):
    return [(g, i, k, f"row {g}/{i}") for g in range(groups) for k, i in items(n, g)]


def test_demux_of_a_table(spark):
    rows = grouped()
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, k int, said string").repartition(5)
    found = DX.demultiplexed(df, F.col("g"), ["i"], F.col("k"), 3, per_class=4).collect()
    assert len(found) == len(rows) and {(r.g, r.i, r.k, r.said) for r in found} == set(rows)
    for g in range(3):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(400))
        want = replay([(k, i) for _, i, k, _ in sorted(r for r in rows if r[0] == g)], 3, 4, 1000)[0]
        assert [(r.i, r.child, r.handed_over) for r in own][: len(want)] == want
    assert DX.demultiplexed(df.limit(0), F.col("g"), ["i"], F.col("k"), 3).count() == 0


def test_demux_of_a_stream_across_a_restart(spark, tmp_path):
    rows, schema = grouped(), "g int, i int, k int, said string"
    parts = [[r for r in rows if r[1] // 100 == p] for p in range(4)]

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = SD.demultiplexed_stream(stream, F.col("g"), ["i"], F.col("k"), 3, per_class=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = q.option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        progress = q.recentProgress
        q.stop()
        return progress

    progress = []
    for name, some in (("one", parts[:2]), ("two", parts[2:])):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            progress += run(name)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    for g in range(3):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.place)
        want, parked, *_ = replay([(k, i) for _, i, k, _ in sorted(r for r in rows if r[0] == g)], 3, 4, 1000)
        assert [(r.i, r.child, r.handed_over) for r in own] == want and len(own) + sum(map(len, parked)) == 400
    sizes = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert sizes and max(sizes) <= 3 * (4 * 3 + 1 + 1)  # for each group what is parked, and its turn


# ------------------------------------------------------------------ balance


def plain_choices(requests, kinds, n, size, seed):
    """The last `size` choices as a plain list."""
    ring, out = [], []
    for request in requests:
        class Plain:
            def share(self, kind):
                return ring.count(kind) / len(ring) if ring else 0.0

            def push(self, kind):
                pass

        picked = BA.chosen(Plain(), f"{seed}/{request}", kinds, n)
        out.append(picked)
        ring = (ring + picked)[-size:]
    return out


def test_balanced_requests_across_a_restart(spark, tmp_path):
    kinds, schema = ["a", "b", "c", "d", "e", "f"], "group string, request long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ST.balanced_requests(stream, kinds, 3, 20, "s").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        progress = q.recentProgress
        q.stop()
        return progress

    progress = []
    for part in range(3):
        spark.createDataFrame([(g, part * 40 + i) for g in "xy" for i in range(40)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        progress += run()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    table = spark.createDataFrame([(g, i) for g in "xy" for i in range(120)], schema)
    batch = {(r.group, r.request): r.chosen for r in BA.balanced_choices(table, F.col("group"), "request", kinds, 3, 20, "s").collect()}
    for g in "xy":
        want = plain_choices(range(120), kinds, 3, 20, f"s/{g}")
        own = sorted((r for r in found if r.group == g), key=lambda r: r.request)
        assert [r.chosen for r in own] == want == [batch[g, i] for i in range(120)]
        assert all(len(set(c)) == 3 for c in want)
        shares = Counter(k for c in want[60:] for k in c)
        assert max(shares.values()) < 1.6 * min(shares.values())  # near equal, whatever came first
    sizes = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert max(sizes) <= 2 * (20 + len(kinds) + 1)


def test_rolling_shares(spark, tmp_path):
    rng = random.Random(2)
    kinds = [rng.choice("aab") for _ in range(2600)]
    spark.createDataFrame([("g", k) for k in kinds], "group string, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    found, _ = drain(ST.balanced(spark.readStream.schema("group string, kind string").parquet(str(tmp_path / "in"))), "rolling")
    want = [kinds[max(0, i - 1000) : i].count(k) / min(i, 1000) if i else 0.0 for i, k in enumerate(kinds)]
    assert [r.share for r in found] == pytest.approx(want)


# ------------------------------------------------------------------ resumed scoring


def test_scores_are_written_once_across_crashes_and_runs(spark, tmp_path):
    schema, out = "k int, payload string", str(tmp_path / "out")
    score = lambda df: C.apply_scorer(df, C.STAND_INS["liqe"])

    def add(first, last):
        spark.createDataFrame([(i, f"t{i}") for i in range(first, last)] * 2, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint, scorer):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.score_into(stream, scorer, out, str(tmp_path / checkpoint), "k").trigger(availableNow=True).start().awaitTermination()

    def keys():
        return sorted(r.k for r in ST.scored(spark, out).collect())

    add(0, 10)
    run("one", score)
    assert keys() == list(range(10))
    add(5, 20)

    def crash_before(df):
        score(df).collect()
        raise RuntimeError("lost between score and append")

    with pytest.raises(Exception, match="lost between"):
        run("one", crash_before)
    assert keys() == list(range(10))
    run("one", score)
    assert keys() == list(range(20))
    # the append was done, but not noted by the query: the batch runs again
    last = max((tmp_path / "one" / "commits").glob("[0-9]"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run("one", score)
    assert keys() == list(range(20))
    # a run with a new checkpoint starts from what the table has
    add(18, 30)
    run("two", score)
    assert keys() == list(range(30))
    # later micro-batches don't read the table: broken files of earlier ones don't matter
    add(30, 35)
    run("two", score)
    for part in (tmp_path / "out").rglob("_batch=0/*.parquet"):
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    add(33, 40)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert stream.isStreaming
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")  # for the schema alone
    try:
        run("two", score)
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    newest = [p for p in (tmp_path / "out").rglob("*.parquet") if p.parent.name not in ("_batch=0",) and "_run" in p.parent.parent.name]
    found = sorted(r.k for p in newest for r in spark.read.parquet(str(p)).collect())
    assert set(range(35, 40)) <= set(found) and len(found) == len(set(found))
