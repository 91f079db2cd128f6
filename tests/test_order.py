"""Running sums, first rows, local shuffles and concurrent scoring."""

import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import aggregates as A
from loomspark.operators import mixing as M
from loomspark.operators import sampling as S
from loomspark.operators import scorers as C


@pytest.mark.parametrize("large", [10**6, 100, 1])
def test_running_sums(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE_GROUP", large)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(6)
    found = {r.i: (r.total, r.n) for r in S.running_sums(df, ["g"], ["i"], {"total": F.col("v"), "n": F.lit(1)}).collect()}
    sums = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        total, n = sums.get(g, (None, 0))
        sums[g] = (total if v is None else (total or 0) + v, n + 1)
        assert found[i] == sums[g]
    assert len(found) == 4000


def test_a_large_bucket_is_dealt_to_many_tasks(spark, monkeypatch):
    """One bucket has nearly all batches, one class nearly all rows: no task sums more than a few ranges."""
    monkeypatch.setattr(S, "LARGE_GROUP", 1000)
    rows = spark.range(20000).select("id", F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("kind"))
    summed = S.running_sums(rows, ["kind"], ["id"], {"n": F.lit(1)}).withColumn("p", F.spark_partition_id())
    sizes = sorted(r["count"] for r in summed.groupBy("p").count().collect())
    assert sizes[-1] < 0.4 * 20000 and sum(n > 2000 for n in sizes) >= 3
    last = {r.kind: r.n for r in summed.groupBy("kind").agg(F.max("n").alias("n")).collect()}
    assert last == {"a": 19800, "b": 200}
    batched = M.batches(rows, "kind", 4, "s", "id")
    heads = M.multiplexed(batched, "kind", {"a": 3, "b": 1}, "s").select("kind", "batch", "position").distinct().collect()
    for kind in "ab":
        places = [r.position for r in sorted((r for r in heads if r.kind == kind), key=lambda r: r.batch)]
        assert places == sorted(places) and len(set(places)) == len(places)


@pytest.mark.parametrize("large", [10**6, 100])
def test_average_precision_of_a_large_class(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE_GROUP", large)
    rng = random.Random(3)
    rows = [(0 if i % 50 else 1, rng.choice([None, *range(40)]), rng.random() < 0.3, i) for i in range(3000)]
    df = spark.createDataFrame([(g, None if s is None else s / 7, int(y), i) for g, s, y, i in rows], "g int, s double, y int, k int")
    found = {r.g: r.ap for r in A.average_precision(df, ["g"], "s", "y", "k").collect()}
    for g in (0, 1):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[3]))
        hits, total = 0, 0.0
        for rank, r in enumerate(own, 1):
            hits += r[2]
            total += hits / rank if r[2] else 0
        assert found[g] == pytest.approx(total / (hits + 1e-8))


@pytest.mark.parametrize(("n", "merged"), [(0, 10), (7, 10), (1, 0), (500, 10), (999, 10), (5000, 10)])
def test_smallest(spark, monkeypatch, n, merged):
    monkeypatch.setattr(S, "MERGED", merged)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("x"))
    want = sorted((r.x, r.id) for r in rows.collect())[:n]
    assert sorted((r.x, r.id) for r in S.smallest(rows, ["x", "id"], n).collect()) == want


def test_weighted_sample_of_many(spark, monkeypatch):
    monkeypatch.setattr(S, "MERGED", 100)
    rows = spark.range(3000).withColumn("w", F.when(F.col("id") < 1500, 4.0).when(F.col("id") < 2900, 1.0).otherwise(0.0))
    sample = S.weighted_sample(rows, "s", "id", F.col("w"), 1000)
    got = {r.id for r in sample.collect()}
    order = sorted((-math.log(r.u) / r.w, r.id) for r in rows.where("w > 0").select("id", "w", S.draw("s", F.col("id")).alias("u")).collect())
    assert got == {i for _, i in order[:1000]} and sum(i < 1500 for i in got) > 700
    assert "limit=1000" not in sample._jdf.queryExecution().executedPlan().toString()  # nor a single task for the drawn rows


def test_vocabulary_is_numbered_over_ranges(spark):
    rows = spark.range(2000).select(F.array(F.concat(F.lit("w"), (F.col("id") % 700).cast("string")), F.lit("z")).alias("labels"))
    found = sorted((r.label_id, r.label) for r in A.vocabulary(rows, "labels").collect())
    assert [x for _, x in found] == sorted({f"w{i}" for i in range(700)} | {"z"}) and [i for i, _ in found] == list(range(701))


@pytest.mark.parametrize("size", [1, 10, 64, 5000])
def test_shuffle_buffer(spark, size):
    rows = spark.range(0, 3000, 1, 3)
    mixed = S.shuffle_buffer(rows, "s", size)
    assert "Exchange" not in mixed._jdf.queryExecution().executedPlan().toString()
    got = [r.id for r in mixed.collect()]
    assert sorted(got) == list(range(3000)) and got == [r.id for r in S.shuffle_buffer(rows, "s", size).collect()]
    moved = [abs(place - i) for place, i in enumerate(got)]
    assert all(got[a] // 1000 == a // 1000 for a in range(3000)) and max(moved) < 2 * size
    assert size == 1 or (sum(moved) / 3000 > min(size, 1000) / 6 and got != [r.id for r in S.shuffle_buffer(rows, "t", size).collect()])


def test_scoring_waits_for_several_answers_at_a_time(spark):
    def batch(_, frame):
        time.sleep(0.2)
        return pd.DataFrame({"s": frame["id"] * 2.0})

    scorer = C.Scorer("x", ("id",), "s double", batch)
    began = time.time()
    rows = C.apply_scorer(spark.range(0, 100, 1, 1), scorer, calls=C.Calls(workers=20)).collect()
    assert time.time() - began < 10  # one after the other they would take 20 seconds
    assert {r.id: r.s for r in rows} == {i: 2.0 * i for i in range(100)} and all(r.x_error is None for r in rows)


def test_limited_keys_are_changed(spark):
    def batch(model, frame, key):
        model[key] = model.get(key, 0) + 1
        if key == "dead" or (key == "short" and model[key] > 3):
            raise C.RateLimited(key)
        return pd.DataFrame({"s": frame["id"] * 1.0, "by": [key] * len(frame)})

    scorer = C.Scorer("x", ("id",), "s double, by string", batch, dict)
    rows = C.apply_scorer(spark.range(0, 10, 1, 1), scorer, calls=C.Calls(rows=1, keys=("dead", "short", "good"))).collect()
    assert [r.by for r in rows] == ["short"] * 3 + ["good"] * 7 and [r.s for r in rows] == [float(i) for i in range(10)]
    none = C.apply_scorer(spark.range(0, 2, 1, 1), scorer, calls=C.Calls(tries=1, keys=("dead",))).collect()
    assert [(r.s, r.x_error) for r in none] == [(None, "RateLimited: all keys are limited")] * 2


def test_pauses_grow(spark):
    def batch(model, frame):
        model.append(time.time())
        if len(model) < 4:
            raise ValueError("not yet")
        return pd.DataFrame({"s": [b - a for a, b in zip(model, model[1:])][: len(frame)]})

    rows = C.apply_scorer(spark.range(0, 3, 1, 1), C.Scorer("x", ("id",), "s double", batch, list), calls=C.Calls(tries=4, pause=0.1, growth=3.0)).collect()
    first, second, third = (r.s for r in rows)
    assert 0.1 <= first < second < third and 0.3 <= second and 0.9 <= third
