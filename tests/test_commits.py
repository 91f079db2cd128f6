"""Shards written by commits, and their members read by key."""

import json
import random
import tarfile

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from loomspark.sources import members, paths, shards, stores

ROWS = "key string, ext string, payload binary"


def rows(spark, first, last, ext="bin"):
    return spark.createDataFrame([(f"{i:06d}", ext, bytearray(f"payload {i}".encode() * (i % 7 + 1))) for i in range(first, last)], ROWS)


def read(spark, root):
    found = shards.read_members(spark, paths.listed(spark, f"{root}/*.tar")).collect()
    assert all(r.error is None for r in found)
    return sorted(r.key for r in found)


def test_writes_go_on_where_the_last_one_ended(spark, tmp_path):
    root = str(tmp_path / "out")
    shards.write_shards(rows(spark, 0, 1), root)
    shards.write_shards(rows(spark, 1, 2), root)
    shards.write_shards(rows(spark, 2, 60).repartition(3), root, maxcount=10)
    assert read(spark, root) == [f"{i:06d}" for i in range(60)]
    names = sorted(p.name for p in (tmp_path / "out").glob("*.tar"))
    assert names == [f"{i:05d}.tar" for i in range(len(names))] and not (tmp_path / "out" / "_parts").exists()
    shards.write_shards(rows(spark, 100, 110), root, mode="overwrite")
    assert read(spark, root) == [f"{i:06d}" for i in range(100, 110)]


def test_shards_from_before_the_log_stay(spark, tmp_path):
    with tarfile.open(tmp_path / "00004.tar", "w") as tar:
        tar.addfile(tarfile.TarInfo("old.txt"))
    shards.write_shards(rows(spark, 0, 3), str(tmp_path), maxcount=1)
    assert read(spark, tmp_path) == ["000000", "000001", "000002", "old"]


def test_batches_of_a_writer_count_once(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch in (0, 1, 1, 0, 2):
        shards.write_shards(rows(spark, batch * 10, batch * 10 + 10), root, writer="w", batch=batch)
    shards.write_shards(rows(spark, 90, 91), root, writer="other", batch=0)
    assert read(spark, root) == [f"{i:06d}" for i in [*range(30), 90]]


class Context:
    def __init__(self, partition, attempt):
        self.partition, self.attempt = partition, attempt

    def partitionId(self):
        return self.partition

    def attemptNumber(self):
        return self.attempt


def test_lost_and_repeated_tasks_add_nothing(spark, tmp_path, monkeypatch):
    """A task that dies in the middle, one that runs twice, and a write that is given up."""
    root = str(tmp_path / "out")
    own = [{"key": f"k{i}", "ext": "x", "payload": b"p" * i} for i in range(9)]

    def run(writer, partition, attempt, what):
        monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Context(partition, attempt)))
        return writer.write(iter(what))

    def dying():
        yield from own[:4]
        raise RuntimeError("lost")

    writer = shards._Writer(root, 2, 10**9, "token", None, 0, False)
    with pytest.raises(RuntimeError):
        run(writer, 0, 0, dying())
    first, second = run(writer, 0, 1, own[:4]), run(writer, 0, 2, own[:4])
    assert first.groups != second.groups
    rest = run(writer, 1, 0, own[4:])
    writer.commit([second, rest, None])
    given_up = shards._Writer(root, 2, 10**9, "other", None, 0, False)
    run(given_up, 0, 0, own)
    given_up.abort([None])
    monkeypatch.undo()
    assert read(spark, root) == [f"k{i}" for i in range(9)] and not (tmp_path / "out" / "_parts").exists()


def test_a_published_commit_is_finished_by_whoever_comes_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    shards.write_shards(rows(spark, 0, 4), root, maxcount=1)
    log = stores.CommitLog(root)
    for name in ("a", "b"):
        (tmp_path / "out" / "_parts" / "t").mkdir(parents=True, exist_ok=True)
        with tarfile.open(tmp_path / "out" / "_parts" / "t" / f"{name}.tar", "w") as tar:
            tar.addfile(tarfile.TarInfo(f"{name}.txt"))
    real = log.fs
    moves = []

    class Dying:
        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, part, name):
            if moves:
                raise OSError("the driver is lost")
            moves.append(name)
            real.move(part, name)

    log.fs = Dying()
    monkeypatch.setattr(stores, "MOVES", 1)
    published = log._published
    log._published = lambda entry: (setattr(log, "fs", real), published(entry), setattr(log, "fs", Dying()))[1]
    with pytest.raises(OSError, match="lost"):
        log.commit([{f"_parts/t/{n}.tar": "{number}.tar"} for n in ("a", "b")], "w", 3)
    assert "b" not in read(spark, root)
    again = stores.CommitLog(root)
    assert again.commit([{"_parts/t/a.tar": "{number}.tar"}], "w", 3) == 0  # the same batch, run again
    assert read(spark, root) == ["000000", "000001", "000002", "000003", "a", "b"]


def test_writers_at_the_same_time_get_numbers_of_their_own(tmp_path, monkeypatch):
    """An entry that another writer publishes first is taken again behind it."""
    logs = [stores.CommitLog(str(tmp_path)) for _ in range(2)]
    (tmp_path / "_parts").mkdir()
    for n in "ab":
        (tmp_path / "_parts" / f"{n}.tar").write_text(n)
    published, late = logs[0]._published, []

    def overtaken(entry):
        if not late:
            late.append(logs[1].commit([{"_parts/b.tar": "{number}.tar"}]))
        return published(entry)

    monkeypatch.setattr(logs[0], "_published", overtaken)
    assert logs[0].commit([{"_parts/a.tar": "{number}.tar"}]) == 1 == late[0]
    assert (tmp_path / "00000.tar").read_text() == "b" and (tmp_path / "00001.tar").read_text() == "a"
    assert [json.loads(p.read_text())["next"] for p in sorted((tmp_path / "_commits").glob("*.json"))] == [1, 2]


def test_streamed_shards(spark, tmp_path):
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    for i in range(3):
        rows(spark, i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        shards.stream_shards(stream, root, str(tmp_path / "checkpoint"), maxcount=4).trigger(availableNow=True).start().awaitTermination()

    run()
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]"), key=lambda p: int(p.name))
    last.unlink()  # as if the query had died between its write and its own commit: the last batch runs again
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    rows(spark, 30, 40).coalesce(1).write.mode("append").parquet(source)
    run()
    assert read(spark, root) == [f"{i:06d}" for i in range(40)]


# ------------------------------------------------------------------ members by key


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shards"))
    rng = random.Random(3)
    data = {(f"k{i:04d}/{'long' * 40 if i % 50 == 0 else 'x'}", ext): rng.randbytes(rng.randint(0, 5000)) for i in range(300) for ext in ("jpg", "json")}
    shards.write_shards(spark.createDataFrame([(k, e, bytearray(p)) for (k, e), p in data.items()], ROWS), root, maxcount=40)
    return root, data


def test_places_by_writer_and_by_headers(spark, shop):
    root, data = shop
    written = {(r.key, r.ext, r.shard.rsplit("/", 1)[1], r.offset, r.size) for r in members.written_index(spark, root).collect()}
    found = {(r.key, r.ext, r.shard.rsplit("/", 1)[1], r.offset, r.size) for r in members.indexed(spark, paths.listed(spark, f"{root}/*.tar")).collect()}
    assert written == found and {k[:2] for k in written} == set(data)


def test_lookup_by_key(spark, shop, tmp_path):
    root, data = shop
    members.write_by_key(members.written_index(spark, root), str(tmp_path / "index"), buckets=8)
    wanted = spark.createDataFrame([(k,) for k, _ in list(data)[::37]] + [("nobody",)], "key string")
    places = members.by_key(spark, str(tmp_path / "index"), wanted, buckets=8)
    got = {(r.key, r.ext): bytes(r.payload) for r in members.fetched(places).collect()}
    keys = {k for k, _ in list(data)[::37]}
    assert got == {k: p for k, p in data.items() if k[0] in keys}


def test_bytes_read_grow_with_the_keys(spark, shop):
    root, data = shop
    places = members.written_index(spark, root).orderBy("shard", "offset").toArrow().to_batches()[0]
    counted = []

    class Counting:
        def __init__(self, shard):
            self.file = stores.file_system(shard)[0].open_input_file(stores.file_system(shard)[1])

        def read_at(self, n, offset):
            counted.append(n)
            return self.file.read_at(n, offset)

        def close(self):
            self.file.close()

    for step in (1, 10, 100):
        counted.clear()
        some = places.take(pa.array(range(0, places.num_rows, step)))
        got = [r for b in members.read_places(iter([some]), Counting) for r in b.to_pylist()]
        assert sum(counted) == sum(some.column("size").to_pylist()) == sum(len(r["payload"]) for r in got)
        assert all(data[r["key"], r["ext"]] == r["payload"] for r in got)


def test_cache_is_filled_once(spark, shop, tmp_path):
    root, data = shop
    places, cache = members.written_index(spark, root), str(tmp_path / "cache")
    few = places.where("key < 'k0010'")
    want = {k: p for k, p in data.items() if k[0] < "k0010"}
    for _ in range(2):
        assert {(r.key, r.ext): bytes(r.payload) for r in members.cached(spark, few, cache).collect()} == want
        assert spark.read.parquet(cache).count() == len(want)
    more = members.cached(spark, places.where("key < 'k0020'").withColumn("shard", F.when(F.col("key") < "k0010", "nowhere.tar").otherwise(F.col("shard"))), cache)
    assert {(r.key, r.ext) for r in more.collect()} == {k for k in data if k[0] < "k0020"}  # what was cached isn't read from shards again
    assert members.cached(spark, places.where("key = 'none'"), str(tmp_path / "new")).count() == 0
