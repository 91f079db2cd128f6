"""Literal fixtures for expressions, with values at every boundary."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark.functions import geometry as G
from loomspark.functions import judge as J
from loomspark.functions import text as X
from loomspark.functions import vector as V
from loomspark.operators import rules as R
from loomspark.operators import sampling as S


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("text,want", [("Add a hat", "en"), ("改成蓝色", "ch"), ("X改", "en"), ("123", "en"), ("1改", "ch"), ("", None), (None, None)])
def test_script_language(ev, text, want):
    assert ev(X.script_language(lit(text).cast("string"))) == want


def test_text(ev):
    t = lit('将“早上好”改为"晚上好"')
    assert ev(X.quoted(t)) == "晚上好" and ev(X.quoted(t, 2)) == "早上好" and ev(X.quoted(lit("none"))) is None
    assert ev(X.normalised(lit("A b-C 9!"))) == "abc9"
    assert ev(X.parts(lit(" a && b&&c "))) == ["a", "b", "c"]
    assert ev(X.canonical(lit("a,  b.c {} {x}"), "{}")) == "a bc {} x"
    assert ev(X.between(lit("p<start>q<end>r"), "<start>", "<end>")) == "q" and ev(X.between(lit("pq"), "<start>", "<end>")) is None
    assert ev(X.has_special(lit("a@b"))) and not ev(X.has_special(lit("a, b. 好！")))
    assert ev(X.sentences(lit("Keep this. And THAT too"))) == ["Keep this", "And THAT too"]
    assert ev(X.fill_template(lit("<a>-<b>"), a=lit("1"), b=lit("2"))) == "1-2"
    assert ev(X.messages(lit("s"), lit("u")))[1].content == "u"


def test_judge(ev):
    assert ev(J.score_pair(lit("[8, 9] ok"))) == [8, 9] and ev(J.score_pair(lit("score = [ 7 ,10 ]"))) == [7, 10]
    for bad in ("[8.5, 9]", "[1,2,3]", "none"):
        assert ev(J.score_pair(lit(bad))) is None
    assert ev(J.numbered_scores(lit("Score 1: 4\nScore 2: 5\nScore 10: 3\nScore 3:2"))) == [4, 5]
    assert ev(J.parse_answer(lit('{"score": 7, "reasoning": "x"}'))).score == [7.0]
    assert ev(J.parse_answer(lit('noise {"score": [7, 8],\n "reasoning": "x"} noise'))).score == [7.0, 8.0]
    assert ev(J.parse_answer(lit("11"))) is None and ev(J.parse_answer(lit("{broken"))) is None
    assert ev(J.is_score_list(lit("[0, 10]"))) and not ev(J.is_score_list(lit("[0, 11]"))) and not ev(J.is_score_list(lit("x")))
    assert ev(J.is_named_scores(lit("[score1: 3, score2: 4]"))) and not ev(J.is_named_scores(lit("[score1: 3, score3: 4]")))
    assert ev(J.answers_no(lit("I know"))) and not ev(J.answers_no(lit("I know"), True))
    assert ev(J.after_thinking(lit("<think>a</think> b "))) == "b"


@pytest.mark.parametrize("text,want", [
    ('{score: 7, reasoning: fine}', '{"score": [7], "reasoning": "fine"}'), ('{"score": [7, 8], reasoning: a, b}', '{"score": [7, 8], "reasoning": "a, b"}'), ("x {ok: TRUE, n: null, f: -1.5} y", '{"ok": true, "n": null, "f": [-1.5]}'),
    ("{}", "{}"), ("no braces", None), ("{just words}", None), (None, None),
])
def test_repair(ev, text, want):
    assert ev(J.repair_json(lit(text).cast("string"))) == want


def test_geometry(ev):
    assert [ev(G.multiple_of_16(lit(x))) for x in (8, 24, 40, 100, 504)] == [0, 32, 32, 96, 512]
    assert [ev(G.multiple_of_8(lit(x))) for x in (1023, 1028, 1027)] == [1024, 1032, 1024]
    assert ev(G.polygon(lit("(1,2) (-3,4)"))) == [(1, 2), (-3, 4)]
    assert ev(G.merged_size(F.array(lit(10), lit(20)), F.array(lit(4), lit(7)))) == (40, 5)
    regions = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((5, 2), (1, 2), (9, 0))])
    assert ev(G.top_left_order(regions)) == [(9, 0), (1, 2), (5, 2)]


@pytest.mark.parametrize("w,h,bucket,error,kept", [(1024, 1024, 6, 0, True), (1920, 1080, 11, 0.0733, True), (1080, 1920, 1, 0.0223, True), (640, 480, 8, 0.0121, True), (4020, 1000, 12, 1.9978, True), (4040, 1000, 12, 2.0178, False), (100, 1000, 0, 0.3945, True)])
def test_buckets(spark, w, h, bucket, error, kept):
    row = R.bucketed(spark.createDataFrame([(w, h)], "w int, h int"), "w", "h").first()
    assert row.bucket_id == bucket and row.bucket_error == pytest.approx(error, abs=1e-4) and (row.bucket_error < R.MAX_BUCKET_ERROR) == kept


def doc(**fields):
    import json

    return json.dumps(fields, ensure_ascii=False)


STEP = {"label": "step1x", "score_7b": "[5, 4]", "liqe_score_edit": 3, "aesthetic_score_v2_5_edit": 4.8, "liqe_score_clip_edit": [0.6], "instruction": "go"}
ADMISSION = [
    ({"label": "Delete", "score": "[4, 5]"}, True), ({"label": "Delete", "score": [4, 4]}, False), ({"label": "step1x", "score": "[9, 9]"}, True), ({"label": "step1x", "score": "[9, 8]"}, False),
    ({"label": "step1x", "score": "None"}, True), (STEP, True), (STEP | {"liqe_score_edit": 2.99}, False), (STEP | {"aesthetic_score_v2_5_edit": 4.79}, False), (STEP | {"liqe_score_clip_edit": 0.59}, False),
    (STEP | {"score_7b": "[4, 4]"}, False), (STEP | {"task": "文字更改", "instruction": "改"}, False), (STEP | {"task": "文字更改", "instruction": "改a"}, True), ({"label": "gpt4o", "score_7b": "[1, 1]", "task": "人物修图"}, False),
    ({"label": "gpt4o", "score_7b": "[1, 1]", "task": "x"}, True), ({"label": "gpt4o", "aesthetic_score": 5.9}, False), ({"label": "gpt4o"}, True), ({"label": "other", "caption_en": ""}, False), ({"label": "other", "caption_en": []}, False),
    ({"label": "kontext"}, True), ({"label": "AnyEdit"}, False), ({"label": "AnyEdit", "label_fine": "x"}, True), ({"label": "grit-entity-new"}, False), ({"label": "grit-entity-new", "caption_en": "c"}, True),
]


@pytest.mark.parametrize("fields,keep", ADMISSION)
def test_admission(ev, fields, keep):
    assert ev(R.rejected(R.read_metadata(lit(doc(**fields))))) == (not keep)


def test_admission_variants(ev):
    m = R.read_metadata(lit(doc(label="gpt4o", aesthetic_score=5.9)))
    assert not ev(R.rejected(m, R.VARIANTS["512"])) and not ev(R.rejected(m, R.VARIANTS["qwen_1024"]))
    m = R.read_metadata(lit(doc(**(STEP | {"task": "文字更改", "instruction": "改"}))))
    assert ev(R.rejected(m, R.VARIANTS["512"])) and not ev(R.rejected(m, R.VARIANTS["qwen_512"]))


@pytest.mark.parametrize("fields,controls,want", [
    ({"label": "Delete", "instruction_zh": "删"}, False, ("删", "1.0.jpg", "2.jpg", "removal")), ({"label": "Style Transfer", "style_zh": "s"}, False, ("s", "jpg", "png", "style")),
    ({"label": "OmniConsistency", "instruction": "i", "task": "x"}, False, ("i", "1.0.jpg", "2.jpg", "style")), ({"label": "OmniConsistency", "instruction": "i", "task": "text change"}, False, ("i", "1.0.jpg", "2.jpg", "text change")),
    ({"label": "kontext", "instruction": "i", "task": "t"}, False, ("i", "1.0.jpg", "2.jpg", "t")), ({"label": "AnyEdit", "caption_en": "c", "label_fine": "f"}, False, ("c", "1.0.jpg", "2.jpg", "f")),
    ({"label": "new", "caption_en": ["only"]}, False, ("only", "1.0.jpg", "2.jpg", "new")), ({"label": "Subjects200K", "caption_en": "c"}, False, ("c", "1.0.jpg", "2.jpg", "subject")),
])
def test_projection(ev, fields, controls, want):
    assert tuple(ev(R.projected(R.read_metadata(lit(doc(**fields))), lit("k"), lit(controls)))) == want


def test_control_projection(ev):
    row = ev(R.projected(R.read_metadata(lit(doc(label="Subjects200K"))), lit("k"), lit(True)))
    assert row.edit_type == "low_leval" and (row.instruction[:5], row.source) in (("Canny", "1.1.jpg"), ("Depth", "1.2.jpg"))


@pytest.mark.parametrize("d,i,t,keep", [(0.96, 0.96, 0.3, False), (0.96, 0.9, 0.3, True), (0.995, 0.9, 0.3, False), (0.79, 0.9, 0.3, False), (0.9, 0.64, 0.3, False), (0.9, 0.9, 0.22, False)])
def test_subject_band(ev, d, i, t, keep):
    assert ev(R.subject_band(lit(d), lit(i), lit(t))) == keep


def test_gates(ev):
    assert ev(R.area_gate(lit(900), lit(900))) and not ev(R.area_gate(lit(899), lit(899)))
    assert ev(R.source_gate(lit(5.5), 5.5)) and not ev(R.source_gate(lit(5.49), 5.5)) and ev(R.source_gate(lit(None).cast("double"), 5.5))
    assert ev(R.score_gate(F.array(lit(2), lit(2)))) and not ev(R.score_gate(F.array(lit(1), lit(2))))
    one = lambda x: (lit(x), lit(x))
    assert not ev(R.change_gate(one(3.0), (lit(5.0), lit(5.5)), (lit(0.5), lit(0.6)))) and ev(R.change_gate((lit(3.0), lit(3.1)), (lit(5.0), lit(5.5)), (lit(0.5), lit(0.6))))
    assert ev(R.drop_gate((lit(4.0), lit(3.9)), (lit(None).cast("double"), lit(5.0)), (lit(0.5), lit(0.5))))


def test_tasks(spark):
    rows = spark.createDataFrame([("removal",), ("attribute_modification",), ("复杂推理",), (None,)], "task string")
    got = {r.task: r.task_id for r in R.with_task_id(rows, "task", R.task_table(spark)).collect()}
    assert got == {"removal": 1, "attribute_modification": 7, "复杂推理": 0, None: 0}
    assert sum(R.BUCKET_SHARES) == pytest.approx(1.0)


def test_vectors(ev):
    v = lambda *x: F.array(*[lit(float(i)) for i in x])
    assert ev(V.cosine(v(1, 0), v(0, 1))) == 0 and ev(V.cosine_share(v(1, 0), v(1, 0))) == 1 and ev(V.cosine(v(0, 0), v(1, 0))) is None
    assert sum(ev(V.softmax(v(1000, 1001)))) == pytest.approx(1)
    assert ev(V.padded(F.array(lit(5), lit(6)), 4)) == [5, 6, 0, 0] and ev(V.padded(F.array(lit(5), lit(6)), 1)) == [5]
    assert ev(V.schedule(4, lit(1024), shift=False)) == [1.0, 0.75, 0.5, 0.25, 0.0]


def test_draws(ev):
    assert 0 < ev(S.draw("s", lit("k"))) < 1
    assert sorted(ev(S.draws_without_replacement("s", lit(1), F.array(lit("a"), lit("b")), 5))) == ["a", "b"]
    with pytest.raises(ValueError):
        S.split_by_hash("s", lit(1), {"a": 0.5, "b": 0.6})


def test_byte_pair_encoding_as_the_public_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomspark.functions import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = bpe.Vocabulary(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = ["the", "ing", " ", "  ", "\n", "\t", "é", "中文", "🙂", "'s", "1", "234", "x" * 40, "_", "A", " ", "...", "don't", "\r\n", "é"]
    texts = ["", " ", "a", "Hello, world!  \n\n it's 2024."] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]]
    for text in texts:
        assert own.encode(text) == other.encode(text, add_special_tokens=False).ids, repr(text[:80])
