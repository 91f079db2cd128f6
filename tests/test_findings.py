"""Cases that reviews have found."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import judge as J
from loomspark.operators import lookup as L
from loomspark.plans.catalog import load


@pytest.mark.parametrize("taken,want", [(range(1, 3000), 1), (range(2, 3000), 1), ([*range(1, 1999), 2000], 1999), (range(1, 2000), 1), ([], 1), ([1, 2, None], 1), ([0, -1, 1], 2)])
def test_next_free_number_as_its_sql(spark, tmp_path, taken, want):
    orders = spark.createDataFrame([(n,) for n in taken], "o_custkey long")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    query = load()["next_free_number"]
    got = [r.next for r in query.run(spark, str(tmp_path)).collect()]
    assert got == [want] == [r[0] for r in con.execute(query.oracle).fetchall()]
    assert L.next_free(spark.range(1, 3000), "id").first().next == 3000  # no range: no end


def test_word_no_beside_other_letters(spark):
    texts = ["nó", "ñno", "noñ", "no\u0345", "\U0001d4a9no", "\u0660no", "noß", "ſno", "\u0130no", "no\u0130", "no\u0131", "no_", "_no", "no1", "NO", "I know", "\u212ano", "no\n", "e\u0301no", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", J.answers_no(F.col("t")), J.answers_no(F.col("t"), True)).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE odd (i INT, t VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute("SELECT i, contains(lower(t), 'no'), regexp_matches(lower(t), '\\bno\\b') FROM odd ORDER BY i").fetchall()
    assert [tuple(r) for r in got] == want


def test_windows_of_frequent_anchors_stay_packed(spark, monkeypatch):
    """A frequent passage costs a row for each text and part, not for each window; results are those of brute force."""
    import random
    from collections import Counter

    from loomspark.llm import substrings

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = [[f"a{i}x{j}" for j in range(rng.randint(0, 40))] + passage + [f"b{i}x{j}" for j in range(rng.randint(0, 40))] for i in range(300)]
    for i in range(0, 300, 7):
        texts[i][len(texts[i]) // 2] = f"c{i}"
    made = spark.sparkContext.accumulator(0)
    real = substrings._window_rows

    def counted(batches):
        for batch in real(batches):
            made.add(batch.num_rows)
            yield batch

    def run(hot):
        made.value = 0
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "_window_rows", counted)
        rows = substrings.remove_repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
        return {r.doc_id: (r.n_removed, r.kept_text) for r in rows}, made.value

    window = substrings.WINDOW
    counts = Counter(tuple(t[k : k + window]) for t in texts for k in range(len(t) - window + 1))
    want = {}
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t) - window + 1) if counts[tuple(t[k : k + window])] > 1 for j in range(k, k + window)}
        want[i] = len(gone), " ".join(w for j, w in enumerate(t) if j not in gone)
    (usual, rows), (parted, more) = run(10_000), run(100)
    assert usual == want == parted
    assert more <= 3 * rows
    plan = substrings.remove_repeats(spark.createDataFrame([(0, "a")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_near_duplicate_stage_follows_operator_nine(spark, sf, monkeypatch):
    """Groups of operator 9 whose texts pass the exact check are dropped even where MinHash bands miss them."""
    import corpus_pipeline
    from loomspark.llm import shingles, simhash

    words = [f"w{i}" for i in range(2000)]
    changed = [*words[:1990], "x", *words[1991:]]
    same = " ".join(["a b c d e f g"] * 200)
    texts = [" ".join(words), " ".join(changed), same, same + " " + " ".join(f"x{i}" for i in range(12)), "other", None, None]
    docs = spark.createDataFrame([*enumerate(texts), (None, "other")], "doc_id long, text string")
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert prints == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}  # 2 and 3 agree in four bits, their sets of shingles don't
    kept = lambda: sorted((r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()), key=str)
    assert kept() == [0, 2, 3, 4, 5]
    monkeypatch.setattr(shingles, "near_copies", lambda docs: docs.select("doc_id", F.col("doc_id").alias("component_id")))  # no band shared
    assert kept() == [0, 2, 3, 4, 5, 6, None]  # the pair stays linked; short texts have no shingles to check


def test_many_masks_at_once(spark):
    """Masks of all widths share the arrays of one batch; before, each took 2.7 ms."""
    import random
    import time

    import numpy as np

    from loomspark.operators import regions as R

    rng = random.Random(4)
    rows = [(0, None, 3), (1, [4, 2], None), (2, [], 5), (3, [12], 4), (4, [0, 12], 4)]
    for i in range(5, 200):
        width, bits = rng.randint(1, 9), [rng.random() < 0.4 for _ in range(rng.randint(0, 80))]
        runs, last = [0], False
        for bit in bits[: len(bits) // width * width]:
            if bit != last:
                runs.append(0)
            runs[-1] += 1
            last = bit
        rows.append((i, runs, width))
    masks = spark.createDataFrame(rows, "id int, runs array<int>, width int").coalesce(1)
    whole = {r.id: r.regions for r in R.mask_regions(masks, "runs", "width", 2).collect()}
    for i, runs, width in rows:
        want = None if runs is None or width is None else R.regions_of(runs, width, 2)
        assert (None if whole[i] is None else [x.asDict() for x in whole[i]]) == want, i
    some = {r.id: r.regions for r in R.mask_regions(masks, "runs", "width", 2, fields=["label", "area", "x"]).collect()}
    assert all(some[i] == (None if w is None else [(x.label, x.area, x.x) for x in w]) for i, w in whole.items())
    n = 20_000
    runs = np.array([[3, 2, 6, 2, 6, 2, 43]] * n).ravel()
    began = time.time()
    counts, (area,) = R.regions_of_masks(runs, np.full(n, 7), np.full(n, 8), 4, ["area"])
    assert counts.tolist() == [1] * n and area.tolist() == [6] * n and time.time() - began < 5


def test_scorers_get_small_batches(spark):
    """A scorer's batch of long texts is bounded by its bytes: 64 MB before."""
    import pandas as pd

    from loomspark.operators import scorers as C

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20_000).alias("payload"))
        seen = C.Scorer("seen", ("payload",), "seen long", lambda _, f: pd.DataFrame({"seen": [int(f["payload"].str.len().sum())] * len(f)}))
        found = C.chained(docs, [(seen, "seen > 0")]).agg(F.max("seen").alias("most"), F.count("*").alias("n")).first()
        assert found.n == 2000 and found.most <= 5 << 20
    finally:
        spark.conf.set(name, before)


def test_many_shards_share_tasks(spark, tmp_path):
    """The headers of shards are read by as many tasks as there are shuffle partitions: one a shard before."""
    from loomspark.sources import members as ME
    from loomspark.sources import paths, shards

    rows = spark.range(60).select(F.col("id").cast("string").alias("key"), F.lit("txt").alias("ext"), F.lit("x").cast("binary").alias("payload"))
    shards.write_shards(rows, str(tmp_path / "s"), maxcount=2)
    places = ME.indexed(spark, paths.listed(spark, f"{tmp_path}/s/*.tar"))
    assert places.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) < 30
    assert sorted(int(r.key) for r in places.collect()) == list(range(60))
