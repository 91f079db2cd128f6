"""Admission, projection and construction rules for edit records, as data and column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import has_latin

# Task ids and their aliases; an alias of two ids takes the first.
TASKS: dict[int, list[str]] = {
    1: ["删除主体", "removal", "remove", "ObjectRemoval", "WaterMarkRemoval", "SnowRemoval"],
    2: ["添加主体", "addition", "add"],
    3: ["风格更改", "style", "style_change", "change style"],
    4: ["背景更改", "background_change", "change background"],
    5: ["颜色更改", "color_alter", "Colorization"],
    6: ["材料更改", "material_alter", "材质更改", "material_change", "visual_material_change"],
    7: ["动作更改", "motion_change", "action_change", "attribute_modification"],
    8: ["替换主体", "subject-replace", "swap", "replace", "replace object"],
    9: ["人物修图", "ps_human", "appearance_alter", "change expression"],
    10: ["文字更改", "text_change", "text change"],
    11: ["色调变换", "色调迁移", "tune_transfer", "tone_transfer"],
    12: ["相机移动", "movement", "rotation_change", "resize", "Camera Move Editing"],
    13: ["Reasoning", "implicit_change", "relation", "Reasoning Editing"],
    14: ["low_leval"],
    15: ["subject", "style transfer"],
}

# Bucket shapes (w, h) and their shares.
BUCKETS = [(720, 1456), (752, 1392), (784, 1312), (832, 1248), (880, 1184), (944, 1104), (1024, 1024), (1104, 944), (1184, 880), (1248, 832), (1312, 784), (1392, 752), (1456, 720)]
BUCKET_SHARES = [0.05, 0.012, 0.006, 0.029, 0.025, 0.067, 0.499, 0.064, 0.025, 0.075, 0.036, 0.045, 0.067]
MAX_BUCKET_ERROR = 2.0

#: Metadata fields of an edit record; producers write subsets. Numbers may come as one-element lists, scores as text.
_KINDS = {
    T.StringType(): "label task instruction instruction_zh instruction_en caption_en_ori label_fine style_zh",
    T.ArrayType(T.StringType()): "caption_en",
    T.ArrayType(T.IntegerType()): "score score_7b",
    T.DoubleType(): "aesthetic_score liqe_score liqe_score_edit liqe_score_clip liqe_score_clip_edit aesthetic_score_v2_5 aesthetic_score_v2_5_edit dino clipI clipT",
}
EDIT_SCHEMA = T.StructType([T.StructField(name, kind) for kind, names in _KINDS.items() for name in names.split()])


def read_metadata(raw: Column) -> Column:
    """A metadata document as a typed struct: lists of one number unwrapped, scores parsed from text, lone captions wrapped."""
    doc = F.try_parse_json(raw)

    def field(f: T.StructField) -> Column:
        get = lambda path, kind: F.try_variant_get(doc, path, kind)
        path = f"$.{f.name}"
        if isinstance(f.dataType, T.DoubleType):
            return F.coalesce(get(f"{path}[0]", "double"), get(path, "double"))
        if f.dataType == T.ArrayType(T.IntegerType()):
            return F.coalesce(get(path, "array<int>"), F.from_json(get(path, "string"), "array<int>"))
        if f.dataType == T.ArrayType(T.StringType()):
            return F.coalesce(get(path, "array<string>"), F.when(get(path, "string").isNotNull(), F.array(get(path, "string"))))
        return get(path, "string")

    return F.struct(*[field(f).alias(f.name) for f in EDIT_SCHEMA.fields])


def task_table(spark, overrides: dict[str, int] | None = None) -> DataFrame:
    """(alias, task_id), one row an alias."""
    found: dict[str, int] = {}
    for number, aliases in TASKS.items():
        for alias in aliases:
            found.setdefault(alias, number)
    found |= overrides or {}
    return spark.createDataFrame(list(found.items()), "alias string, task_id int")


def with_task_id(df: DataFrame, task: str, table: DataFrame) -> DataFrame:
    """Left lookup by alias; unknown and null tasks get 0. Spark broadcasts the table where its size is under the threshold."""
    joined = df.join(table.select(F.col("alias").alias("__alias"), F.col("task_id").alias("__task_id")), F.col(task) == F.col("__alias"), "left")
    return joined.withColumn("task_id", F.coalesce("__task_id", F.lit(0))).drop("__alias", "__task_id")


def array_total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


@dataclass(frozen=True)
class Variant:
    """What the training variants differ in."""

    max_aspect: float | None = None
    latin_rule: bool = True
    aesthetic_rule: bool = False


VARIANTS = {"1024": Variant(None, True, True), "512": Variant(1.3, True, False), "qwen_1024": Variant(1.3, False, False), "qwen_512": Variant(1.3, False, False)}


# The labels, tasks and least scores inside the rules below.
def rejected(m: Column, variant: Variant = VARIANTS["1024"]) -> Column:
    """Whether the per-label rules reject a record with metadata struct m (EDIT_SCHEMA). Comparisons with missing values don't reject."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    label, task = m["label"], m["task"]
    has_7b = m["score_7b"].isNotNull()
    step_7b = has_7b & ((m["liqe_score_edit"] < 3) | (m["aesthetic_score_v2_5_edit"] < 4.8) | (m["liqe_score_clip_edit"] < 0.6) | (array_total(m["score_7b"]) < 9))
    step = step_7b | (~has_7b & (array_total(m["score"]) < 18))
    if variant.latin_rule:
        step = yes(step) | yes((task == "文字更改") & ~has_latin(m["instruction"]))
    gpt = has_7b & task.isin("动作更改", "人物修图", "文字更改")
    if variant.aesthetic_rule:
        gpt = yes(gpt) | yes(~has_7b & (m["aesthetic_score"] < 6))
    by_label = (
        F.when(label == "grit-entity-new", m["caption_en_ori"].isNull() & m["caption_en"].isNull())
        .when(label == "AnyEdit", m["label_fine"].isNull())
        .when(label == "Delete", array_total(m["score"]) < 9)
        .when(label == "step1x", step)
        .when(label == "gpt4o", gpt)
    )
    empty = (F.size(m["caption_en"]) == 0) | (m["caption_en"] == F.array(F.lit("")))
    return yes(by_label) | yes(label.isNotNull() & empty)


def aspect_ok(w: Column, h: Column, limit: float) -> Column:
    return (w / h <= limit) & (h / w <= limit)


def bucketed(df: DataFrame, w: str, h: str, buckets: list[tuple[int, int]] = BUCKETS) -> DataFrame:
    """Adds bucket_id of nearest aspect (first of ties) and bucket_error."""
    aspect = F.col(w).cast("double") / F.col(h).cast("double")
    errors = F.array(*[F.struct(F.abs(F.lit(bw / bh) - aspect).alias("e"), F.lit(i).alias("i")) for i, (bw, bh) in enumerate(buckets)])
    best = F.array_min(errors)
    return df.withColumns({"bucket_id": best["i"], "bucket_error": best["e"]})


def projected(m: Column, key: Column, has_controls: Column, seed: str = "0") -> Column:
    """struct(instruction, source, target, edit_type) by label; source and target name the members to read."""
    from loomspark.operators.sampling import coin, pick_one

    label = m["label"]
    flip = coin(seed, key, 0.5)

    def row(instruction: Column, edit_type: Column, source: Column | str = "1.0.jpg", target: str = "2.jpg") -> Column:
        return F.struct(instruction.alias("instruction"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(target).alias("target"), edit_type.alias("edit_type"))

    caption = F.try_element_at(m["caption_en"], F.lit(1))
    return (
        F.when(
            (label == "Subjects200K") & has_controls,
            row(F.when(flip, "Canny image generates images").otherwise("Depth image generates images"), F.lit("low_leval"), F.when(flip, "1.1.jpg").otherwise("1.2.jpg")),
        )
        .when(label == "Subjects200K", row(caption, F.lit("subject")))
        .when(label.isin("AnyEdit", "PromptfixData"), row(caption, m["label_fine"]))
        .when(label == "Style Transfer", row(m["style_zh"], F.lit("style"), "jpg", "png"))
        .when(label == "Delete", row(m["instruction_zh"], F.lit("removal")))
        .when(label == "OmniConsistency", row(m["instruction"], F.when(m["task"] == "text change", m["task"]).otherwise("style")))
        .when(label.isNotNull() & m["instruction"].isNull() & m["caption_en"].isNotNull(), row(pick_one(seed, key, m["caption_en"]), label))
        .otherwise(row(m["instruction"], m["task"]))
    )


# Construction gates: columns a (aesthetic), q and c (two further quality scores); True keeps.
def source_gate(a: Column, least: float) -> Column:
    """Aesthetic score of the source; records without it pass."""
    return a.isNull() | (a >= least)


def side_gate(w: Column, h: Column, least: int = 1000) -> Column:
    return (w >= least) & (h >= least)


def area_gate(w: Column, h: Column, least: int = 810_000) -> Column:
    return w * h >= least


# Least q, a and c at the input of each producer, and at the output of the two text producers.
INPUT_LEAST = {"bagel": (3.0, 4.0, 0.5), "gpt4o": (3.0, 3.5, 0.55), "style_change": (3.5, 4.5, 0.6), "text": (3.0, 4.0, 0.5)}
OUTPUT_LEAST = {"text": (3.5, 4.5, 0.6)}


def quality_gate(q: Column, a: Column, c: Column, least: tuple[float, float, float]) -> Column:
    return ~((q < least[0]) | (a < least[1]) | (c < least[2]))


# The bounds of scores in the gates below.
def drop_gate(q: tuple[Column, Column], a: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Deletion: scores (before, after) may fall only a little; a missing aesthetic score before counts as zero."""
    before = F.coalesce(a[0], F.lit(0.0))
    return ~((a[1] < 5) | (q[1] < 3.5) | (q[0] - q[1] > 0.2) | (before - a[1] > 0.2) | (c[0] - c[1] > 0.028))


def change_gate(q: tuple[Column, Column], a: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Edits that change next to nothing go."""
    return ~((F.abs(q[0] - q[1]) < 0.02) | (F.abs(c[0] - c[1]) < 0.008) | (F.abs(a[0] - a[1]) < 0.02))


def subject_band(d: Column, i: Column, t: Column) -> Column:
    """Similarities of a subject pair: alike but not the same."""
    return ~(((d > 0.95) & (i > 0.95)) | (d < 0.8) | (i < 0.65) | (t < 0.23) | (d > 0.99) | (i > 0.99))


def style_band(d: Column, i: Column, t: Column) -> Column:
    return ~((d > 0.95) | (i > 0.95) | (t < 0.2))


def score_gate(scores: Column, least: int = 4) -> Column:
    return array_total(scores) >= least


def mask_gate(ratio: Column) -> Column:
    return ratio.between(0.02, 0.35)


def overlap_gate(overlap: Column, area: Column) -> Column:
    return F.try_divide(overlap, area) >= 0.8


def region_gate(area: Column, image_area: Column) -> Column:
    return F.try_divide(area, image_area) >= 0.01


def tag_gate(tags: Column, most: int = 15) -> Column:
    return F.size(tags) <= most


def length_gate(a: Column, b: Column, most: int = 3) -> Column:
    return F.abs(F.length(a) - F.length(b)) <= most


def detections(boxes: Column, box_least: float = 0.3, text_least: float = 0.25) -> Column:
    """Detections (box_score, text_score, ...) over both thresholds."""
    return F.filter(boxes, lambda b: (b["box_score"] > box_least) & (b["text_score"] > text_least))


def contours(regions: Column, least: int = 50) -> Column:
    return F.filter(regions, lambda r: r["area"] >= least)
