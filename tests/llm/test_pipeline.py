"""The pipeline's stages and registered queries."""

import importlib
import itertools
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark, sf, pipeline, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"matches": F.lit(1), "__row": F.lit("r"), "quality_score": F.lit("q")})
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            own = {r.doc_id for r in docs.collect()}
            assert own <= ids
            ids = own
        else:
            assert {r.doc_id for r in out.collect()} == ids


def test_stages_take_empty_and_null(spark, sf, pipeline):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 0
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run_and_queries(spark, sf, pipeline):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
    assert pipeline.run(spark, sf).count() > 0


def test_near_copies_reach_similarity(spark, sf, pipeline):
    rng = random.Random(5)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        for edits in (0, 1, 2, 3, 5, 8):
            own = list(base)
            for i in rng.sample(range(len(own)), edits):
                own[i] = "Changed"
            texts.append(" ".join(own))
    texts += [None, "", " ", "short text", "Short  text", "another short", texts[7]]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if words[i] == words[j] or jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, sf).collect()}
    assert got == {i for i in range(len(texts)) if root(i) == i}


def test_stages_keep_what_brute_force_keeps(spark, sf, pipeline):
    """The rows of each stage but the fitted first one, on the driver's smallest documents, by plain Python."""
    import re

    import pyarrow.parquet as pq

    from loomspark.llm import quality
    from loomspark.llm.lines import MIN_WORDS

    docs = sorted(pq.read_table(f"{sf}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])
    stages = dict(pipeline.STAGES)
    rows = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs], "doc_id long, text string, lang string, source string, n_chars long")

    scored = quality.classify(rows, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    kept = {r.doc_id for r in scored if r.quality_score >= quality.THRESHOLD}
    got = stages["quality"](spark, rows, sf)
    assert {r.doc_id for r in got.collect()} == kept and 0 < len(kept) < len(docs)
    docs = [r for r in docs if r["doc_id"] in kept]

    seen, shapes, texts = set(), {}, {}
    for r in docs:  # lines equal to an earlier one, or one word away from it
        out = []
        for line in (r["text"] or "").split("\n"):
            words = tuple(line.encode().split())
            if not words:
                out.append(line)
                continue
            near = False
            if len(words) >= MIN_WORDS - 1:
                around = {(words[:i] + words[i + 1 :], i) for i in range(len(words))}
                substituted = len(words) >= MIN_WORDS and any(("s", *x) in shapes for x in around)
                shorter = len(words) >= MIN_WORDS and any(x in seen for x, _ in around)
                longer = len(words) + 1 >= MIN_WORDS and ("d", words) in shapes
                near = substituted or shorter or longer
            if words not in seen and not near:
                out.append(line)
            seen.add(words)
            for i in range(len(words)):
                less = words[:i] + words[i + 1 :]
                shapes[("s", less, i)] = shapes[("d", less)] = True
        texts[r["doc_id"]] = "\n".join(out)
    got = stages["line_dedup"](spark, got, sf)
    assert {r.doc_id: r.text or "" for r in got.collect()} == texts

    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        both = len(sets[i] & sets[j])
        if words[i] == words[j] or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    kept = {i for i in texts if root(i) == i}
    got = stages["near_duplicates"](spark, got, sf)
    assert {r.doc_id for r in got.collect()} == kept and len(kept) < len(texts)

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist():
        own = split(r["text"])
        windows |= {tuple(own[k : k + min(10, len(own))]) for k in range(len(own) - min(10, len(own)) + 1)} - {()}
    sizes = {len(w) for w in windows}
    hit = {i for i in kept if any(tuple(own[k : k + n]) in windows for own in [split(texts[i])] for n in sizes for k in range(len(own) - n + 1))}
    got = stages["decontamination"](spark, got, sf)
    assert {r.doc_id for r in got.collect()} == kept - hit and hit

    pieces = sorted((r.doc_id, r.start, r.length) for r in stages["packing"](spark, got, sf).collect())
    at = {}
    for i, start, length in pieces:
        assert start == at.get(i, 0)
        at[i] = start + length
    assert set(at) == kept - hit
