"""Sources, sinks, mixing, scorers and streams."""

import io
import json
import tarfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import aggregates as A
from loomspark.operators import lookup as L
from loomspark.operators import mixing as M
from loomspark.operators import sampling as S
from loomspark.operators import scorers as C
from loomspark.operators import sinks as K
from loomspark.sources import files, paths, shards
from loomspark.streaming import scores as ST


@pytest.mark.parametrize("pattern,want", [
    ("a{000..002}.tar", ["a000.tar", "a001.tar", "a002.tar"]), ("{a,b}{1..2}", ["a1", "a2", "b1", "b2"]), ("x{y}z", ["x{y}z"]), ("{3..1}", ["3", "2", "1"]), ("p{a,b{1,2}}", ["pa", "pb1", "pb2"]), ("{", ["{"]), ("{1..5..2}", ["1", "3", "5"]),
])
def test_braces(pattern, want):
    assert paths.expand_braces(pattern) == want


def test_lists(spark, tmp_path):
    for n in ("b.tar", "a.tar", "c.txt"):
        (tmp_path / n).write_text("x")
    got = paths.listed(spark, f"{tmp_path}/*::{tmp_path}/a.tar")
    assert [p.rsplit("/", 1)[1] for p in got] == ["a.tar", "b.tar", "a.tar"]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")


def test_shards_round_trip(spark, tmp_path):
    rows = [(f"{i:09d}", ext, data) for i in range(23) for ext, data in (("1.0.jpg", png(10 + i, 20)), ("2.jpg", b"two"), ("json", json.dumps({"label": "step1x", "score": "[9, 9]"}).encode()))]
    members = spark.createDataFrame(rows, "key string, ext string, payload binary")
    root = tmp_path / "out"
    shards.write_shards(members.repartition(1), str(root), maxcount=5)
    found = paths.listed(spark, f"{root}/*.tar")
    (root / "bad.tar").write_bytes(b"not a tar" * 100)
    read = shards.read_members(spark, [*found, str(root / "bad.tar")]).cache()
    assert sorted((r.key, r.ext, bytes(r.payload)) for r in read.where("error IS NULL").collect()) == sorted(rows)
    assert read.where("error IS NOT NULL").select("shard").distinct().count() == 1
    for name in found:
        with tarfile.open(name.removeprefix("file:")) as tar:
            assert len({m.name.split(".")[0] for m in tar}) <= 5
    remote = shards.read_remote_members(spark, f"{root}/*.tar")
    assert sorted((r.key, r.ext, bytes(r.payload)) for r in remote.where("error IS NULL").collect()) == sorted(rows) and remote.where("error IS NOT NULL").count() == 1
    wide = shards.samples(read, ["1.0.jpg", "json"])
    sized = wide.select("key", files.image_size(shards.image_keys(F.col("m"), ["1.0.jpg"])).alias("s")).collect()
    assert {(int(r.key) + 10, 20) for r in sized} == {(r.s.w, r.s.h) for r in sized} and len(sized) == 23
    bad = shards.health(read).where("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0].members == 0


def test_image_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\0" * 12
    assert files._size(jpeg) == (64, 48) and files._size(png(3, 4)) == (3, 4) and files._size(b"GIF89a\x05\0\x06\0") == (5, 6)
    for junk in (None, b"", b"x" * 40, b"\xff\xd8\xff"):
        assert files._size(junk) is None


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" a cat \n\n换风格\nb\n")
    assert [r.prompt for r in files.prompts(spark, str(tmp_path / "p.txt"), "风格").collect()] == ["a cat", "b"]
    (tmp_path / "s.log").write_text("Add a hat\t[5, 4]\nAdd a hat\t[1, 1]\nfinal score: [3.0]\nbroken\n")
    log = files.score_log(spark, str(tmp_path / "s.log")).orderBy("line_no").collect()
    assert [(r.line_no, r.instruction, r.score) for r in log] == [(0, "Add a hat", [5.0, 4.0]), (1, "Add a hat", [1.0, 1.0])]
    (tmp_path / "l.json").write_text('{"k1": [1, 2], "k2": []}')
    assert {r.key: r.label_ids for r in files.label_dictionary(spark, str(tmp_path / "l.json")).collect()} == {"k1": [1, 2], "k2": []}
    (tmp_path / "m.csv").write_text('a.jpg,"[cat, dog]"\nb.jpg,"[sun]",val\n')
    assert [(r.labels, r.split) for r in files.multi_label_csv(spark, str(tmp_path / "m.csv")).collect()] == [(["cat", "dog"], "train"), (["sun"], "val")]


def test_file_pairs(spark, tmp_path):
    for folder in ("add", "remove"):
        (tmp_path / folder).mkdir()
        for n in ("Put a hat_in.jpg", "Put a hat_out.jpg", "lone_in.jpg"):
            (tmp_path / folder / n).write_bytes(b"x")
    pairs = files.edit_pairs(files.files(spark, str(tmp_path), "*.jpg"))
    assert {(r.folder, r.instruction) for r in pairs.collect()} == {("add", "Put a hat"), ("remove", "Put a hat")}


def test_annotations(spark):
    rows = spark.createDataFrame([([(0, 100.0), (1, 5000.0), (1, 99999.0)],)], "o array<struct<category:int,area:double>>")
    assert rows.select(files.annotations(F.col("o"), 2).alias("x")).first().x == [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]


# ------------------------------------------------------------------ mixing


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("kind")).cache()


@pytest.mark.parametrize("size", [1, 4, 7])
def test_batches(pool, size):
    rows = M.batches(pool, "kind", size, "s", "id").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.kind, r.batch), []).append(r.slot)
    assert all(sorted(g) == list(range(size)) for g in groups.values())
    assert len({r.id for r in rows}) == len(rows) == 700 // size * size + 300 // size * size


def test_mix_follows_weights(pool):
    mixed = M.multiplexed(M.batches(pool, "kind", 2, "s", "id"), "kind", {"a": 3, "b": 1}, "s").select("kind", "batch", "position").distinct().orderBy("position").collect()
    head = [r.kind for r in mixed[:200]]
    assert 0.65 < head.count("a") / 200 < 0.85 and len(mixed) == 500


def test_mix_exhausts_the_heavy_pipe_first(spark):
    rows = spark.createDataFrame([(i, i // 10) for i in range(20)], "id int, kind int")
    mixed = M.multiplexed(M.batches(rows, "kind", 5, "s", "id"), "kind", {0: 99999999, 1: 1e-7}, "s").orderBy("position", "batch", "slot").collect()
    assert [r.kind for r in mixed] == [0] * 10 + [1] * 10


def test_bad_weights_and_classes(pool):
    for bad in ({}, {"a": 0}, {"a": -1}):
        with pytest.raises(ValueError):
            M.check_weights(bad)
    with pytest.raises(ValueError):
        M.batches(pool, "kind", 0, "s", "id")
    with pytest.raises(Exception, match="out of range"):
        M.classed(pool, F.when(F.col("id") == 5, 9).otherwise(0), 2).collect()


def test_ranks_and_splits(spark):
    rows = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("id"))
    ranked = S.with_rank(rows, ["id"], "r").collect()
    assert all(r.r == r.id + 1 for r in ranked)
    sizes = {r.part: r["count"] for r in S.contiguous_split(rows, 7, ["id"]).groupBy("part").count().collect()}
    assert sizes == {i: 144 if i < 2 else 143 for i in range(7)}


def test_weighted_sample_prefers_weight(spark):
    rows = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    got = [r.id for r in S.weighted_sample(rows, "s", "id", F.col("w"), 200).collect()]
    assert len(set(got)) == 200 and sum(i < 1000 for i in got) > 150


# ------------------------------------------------------------------ metrics, scorers, sinks


def test_average_precision(spark):
    rows = spark.createDataFrame([(0, 0.9, 1, 1), (0, 0.8, 0, 2), (0, 0.7, 1, 3), (0, 0.6, 1, 4)], "g int, s double, y int, k int")
    assert A.average_precision(rows, ["g"], "s", "y", "k").first().ap == pytest.approx(0.80555555287, abs=1e-9)
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0)], "g int, k int, v double")
    assert A.ema(e, "g", ["k"], "v").first().ema == pytest.approx(1.0299)
    assert e.groupBy("g").agg(A.running_ema(["k"], "v").alias("ema")).first().ema == pytest.approx(1.0299)


def test_score_means(spark):
    rows = spark.createDataFrame([("ch", [3.0, 3.0]), ("en", [5.0, 4.0]), ("en", [2.0, 4.0, 9.0])], "lang string, score array<double>")
    got = {(r.lang, r.pos): r["mean"] for r in A.with_sum(A.score_means(rows, "lang"), "lang").collect()}
    assert got == {("ch", 0): 3.0, ("ch", 1): 3.0, ("ch", 2): 6.0, ("en", 0): 3.5, ("en", 1): 4.0, ("en", 2): 7.5, ("total", 0): 3.333, ("total", 1): 3.667, ("total", 2): 7.0}


def test_scorer_isolates_failures(spark):
    def batch(_, frame):
        if (frame["id"] == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"s": frame["id"] * 2.0})

    rows = C.apply_scorer(spark.range(6), C.Scorer("x", ("id",), "s double", batch)).collect()
    assert {r.id: r.s for r in rows} == {0: 0.0, 1: 2.0, 2: 4.0, 3: None, 4: 8.0, 5: 10.0}
    assert [r.x_error for r in rows if r.id == 3] == ["ValueError: three"]
    kept = C.chained(spark.range(50).select(F.col("id").cast("string").alias("payload")), [(C.STAND_INS["aesthetic"], "aesthetic >= 5"), (C.STAND_INS["liqe"], "liqe >= 3")])
    assert 0 < kept.count() < 40


def test_sinks(spark, tmp_path):
    K.write_rolling(spark.range(100).repartition(1), str(tmp_path / "r"), rows=30)
    assert len(list((tmp_path / "r").glob("*.parquet"))) == 4
    good, bad = K.quarantined(spark.createDataFrame([(1,), (None,), (3,)], "x int"), F.col("x") > 2, F.lit("big"))
    assert good.count() == 1 and {r.x for r in bad.collect()} == {None, 3}
    scores = spark.createDataFrame([("a", [1.0, 2.0])], "instruction string, score array<double>")
    for _ in range(2):
        K.write_scores(scores, str(tmp_path / "s"))
    assert [r.score for r in files.score_log(spark, str(tmp_path / "s")).collect()] == [[1.0, 2.0]] * 2


# ------------------------------------------------------------------ streams


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = ST.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    want = ST.event_windows(table).select("start", "event_type", "n")
    assert sorted(map(tuple, spark.table("win").select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ------------------------------------------------------------------ ranks of any type, limits, shards by stream


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "decimal(12,2)", "double"])
def test_ranks_of_any_type(spark, kind):
    base = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("id"))
    value = {"string": F.format_string("k%05d", "id"), "timestamp": F.timestamp_seconds(F.col("id") * 977), "date": F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int"))}.get(kind, F.col("id").cast(kind) / 3)
    rows = base.withColumn("v", F.when(F.col("id") >= 5, value)).withColumn("group", F.col("id") % 3)
    want = {r.id: n for n, r in enumerate(sorted(rows.collect(), key=lambda r: (r.group, r.v is not None, r.v if r.v is not None else 0, r.id)), 1)}
    ranked = S.with_rank(rows, ["group", "v", "id"], "r")
    assert {r.id: r.r for r in ranked.collect()} == want
    assert len({r.p for r in ranked.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


def test_ranks_of_few_and_no_rows(spark):
    assert [r.r for r in S.with_rank(spark.range(1), ["id"], "r").collect()] == [1]
    assert S.with_rank(spark.range(0), ["id"], "r").count() == 0


def test_membership_joins(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c", "c"]), (4, None)], "k int, names array<string>")
    splits = spark.createDataFrame([("a", "train"), ("c", "train"), ("c", "test")], "name string, split string")
    got = {r.k: (r.in_train, r.in_test) for r in L.membership(rows, "k", "names", splits).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (False, False)}


def test_hanging_scorer_is_cut_off(spark):
    def batch(_, frame):
        if (frame["id"] == 2).any():
            time.sleep(60)
        return pd.DataFrame({"s": frame["id"] * 1.0})

    began = time.time()
    rows = C.apply_scorer(spark.range(4).coalesce(1), C.Scorer("x", ("id",), "s double", batch), tries=1, limit=1.0).collect()
    assert time.time() - began < 30
    assert {r.id: r.s for r in rows} == {0: 0.0, 1: 1.0, 2: None, 3: 3.0}
    assert [r.x_error for r in rows if r.id == 2] == ["TimeoutError: no answer within 1 s"]
    with pytest.raises(ZeroDivisionError):
        C.within(5, lambda: 1 / 0)


def test_dispersive_loss_refuses_tables(spark):
    rows = spark.range(20).select("id", F.lit(0).alias("b"), F.lit(1).alias("t"), F.array(F.rand(1), F.rand(2)).alias("v"))
    assert A.dispersive_loss(rows, "v", "t", "id", "b").first().n == 20
    with pytest.raises(Exception, match="over 10"):
        A.dispersive_loss(rows, "v", "t", "id", "b", most=10).collect()


def test_whole_images_are_told_from_cut_ones():
    import zlib

    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    good = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (3).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(bytes(4))) + chunk(b"IEND", b"")
    assert files._whole(good) and not any(files._whole(good[:n]) for n in range(0, len(good)))
    assert not files._whole(good[:40] + b"\x01" + good[41:])  # a checksum that doesn't hold
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\0" * 12
    assert not files._whole(jpeg) and not files._whole(jpeg + b"\xff\xd9")  # an end mark, but no scan (see test_jpeg)
    assert files._whole(b"GIF89a\x05\0\x06\0;") and not files._whole(b"GIF89a\x05\0\x06\0") and not files._whole(None)


def test_shard_urls():
    from pyarrow.fs import LocalFileSystem

    assert all(shards.file_system(u)[1] == "/a/b" and isinstance(shards.file_system(u)[0], LocalFileSystem) for u in ("/a/b", "file:/a/b", "file:///a/b"))


def test_collated_rows_keep_their_slots(pool):
    rows = M.collated(M.batches(pool, "kind", 4, "s", "id"), "kind", ["id", "kind"]).collect()
    assert all(len(r.id) == 4 and set(r[-1]) <= {"a", "b"} for r in rows) and len(rows) == 250
