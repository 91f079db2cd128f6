"""Queries over the driver's tables, one or more for each operator family.

The tables hold no images or edit records, so each operator runs on an analogous table; every one has oracle SQL
unless it draws on Python or on streams. Doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.functions import geometry as G
from loomspark.functions import judge as J
from loomspark.functions import text as X
from loomspark.functions import vector as V
from loomspark.operators import aggregates as A
from loomspark.operators import balance as BA
from loomspark.operators import demux as DX
from loomspark.operators import lookup as L
from loomspark.operators import mixing as M
from loomspark.operators import rules as R
from loomspark.operators import sampling as S
from loomspark.operators import scorers as C
from loomspark.plans.catalog import query
from loomspark.session import scratch, table
from loomspark.sources import files as FS


def _u(seed: str, key: str) -> str:
    """DuckDB form of sampling.draw."""
    return f"((('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT + 1) / 4294967297.0)"


def _i(seed: str, key: str, n: str) -> str:
    """DuckDB form of sampling.draw_int."""
    return f"(('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % ({n}))"


def _scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", "lang", "source", F.array("quality", "toxic").alias("score"))


# ---------------------------------------------------------------- score reports

_SCORE_REPORT = """
WITH scored AS (
  SELECT d.source AS file, d.doc_id AS line_no, d.text AS instruction, d.lang AS lang, l.quality AS s0, l.toxic AS s1
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
first_wins AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, instruction ORDER BY line_no) AS rn FROM scored) t WHERE rn = 1),
long_form AS (
  SELECT lang, 0 AS pos, s0 AS v FROM first_wins UNION ALL SELECT lang, 1 AS pos, s1 AS v FROM first_wins)
SELECT coalesce(lang, 'total') AS lang, CAST(pos AS INT) AS pos, round(avg(CAST(v AS DOUBLE)), 3) AS mean_score, CAST(count(*) AS BIGINT) AS n
FROM long_form GROUP BY GROUPING SETS ((lang, pos), (pos))
"""


@query(_SCORE_REPORT)
def score_report_by_lang(spark, d):
    """First-wins de-dup per file, then means by language and in total in one grouping-sets pass."""
    first = L.first_wins(_scored(spark, d), ["source", "text"], ["doc_id"])
    return A.score_means(first, "lang").select("lang", "pos", F.col("mean").alias("mean_score"), "n")


@query("""WITH long AS (SELECT source, 0 AS pos, quality AS v FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, 1, toxic FROM documents JOIN labels USING (doc_id))
SELECT coalesce(source, 'total') AS source, CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean, count(*) AS n FROM long GROUP BY GROUPING SETS ((source, pos), (pos))""")
def score_mean_by_source(spark, d):
    """Means of each task and over all, not rounded to three digits (A3, A4)."""
    means = A.score_means(_scored(spark, d).select("source", "score"), "source", digits=None)
    return means.select("source", "pos", F.round("mean", 6).alias("mean"), "n")


@query("""SELECT doc_id, round(sqrt(least(quality, toxic + 1)::DOUBLE * least(quality + 3, toxic + 2)::DOUBLE), 6) AS overall FROM labels""")
def overall_score(spark, d):
    """Square root of the product of two minima."""
    r = table(spark, d, "labels")
    return r.select("doc_id", F.round(A.overall(F.array("quality", F.col("toxic") + 1), F.array(F.col("quality") + 3, F.col("toxic") + 2)), 6).alias("overall"))


@query("""SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text""")
def firstwins_dedup(spark, d):
    """The first of equal instructions of a file."""
    return L.first_wins(table(spark, d, "documents").select("source", "text", "doc_id"), ["source", "text"], ["doc_id"])


@query("""SELECT conv_id, role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id, role""")
def lastwins_resume(spark, d):
    """Later lines overwrite earlier ones."""
    return L.last_wins(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "text", "turn")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    """What has no result yet."""
    return L.not_done(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def reuse_scores(spark, d):
    """Scores that exist are taken over."""
    return L.reused(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality")


_TASKS = "(VALUES ('PROMO', 1), ('ECONOMY', 2), ('SMALL', 3), ('LARGE', 4))"


@query(f"SELECT p_partkey, p_type, CAST(coalesce(t.id, 0) AS INT) AS task_id FROM part LEFT JOIN {_TASKS} t(alias, id) ON p_type = alias")
def task_lookup(spark, d):
    """Alias to id by a broadcast table, unknown to 0."""
    tasks = spark.createDataFrame([("PROMO", 1), ("ECONOMY", 2), ("SMALL", 3), ("LARGE", 4)], "alias string, task_id int")
    return R.with_task_id(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", tasks)


@query("SELECT doc_id, source FROM documents WHERE lang NOT IN ('fr', 'de') AND NOT contains(source, '1')")
def stoplist_exclude(spark, d):
    """Stop-list anti join and substring exclusion."""
    stop = spark.createDataFrame([("fr",), ("de",)], "lang string")
    return table(spark, d, "documents").join(F.broadcast(stop), "lang", "left_anti").where(~F.contains("source", F.lit("1"))).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'es')")
def allowed_only(spark, d):
    """Only members of an allow-list (U4)."""
    allowed = spark.createDataFrame([("en",), ("es",)], "lang string")
    return table(spark, d, "documents").join(F.broadcast(allowed), "lang", "left_semi").select("doc_id", "lang")


@query("SELECT source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT source, doc_id FROM documents WHERE n_chars > 100")
def union_roots(spark, d):
    """Concatenated roots, repeats kept."""
    r = table(spark, d, "documents")
    return r.where("lang = 'en'").select("source", "doc_id").unionByName(r.where("n_chars > 100").select("source", "doc_id"))


# ---------------------------------------------------------------- gates

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_QAC = "l_tax * 50 AS q, l_quantity / 10 AS a, l_discount * 10 AS c"


def _line(spark, d):
    return table(spark, d, "lineitem").select(*_KEY.split(", "), "l_returnflag", (F.col("l_tax") * 50).alias("q"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("c"))


@query(f"""SELECT {_KEY}, CASE l_returnflag
  WHEN 'A' THEN NOT coalesce(l_quantity + l_linenumber < 20, false)
  WHEN 'N' THEN NOT (l_tax * 50 < 1 OR l_quantity / 10 < 1.5 OR l_discount * 10 < 0.2 OR l_quantity < 9)
  ELSE true END AS admitted FROM lineitem""")
def admission_rules(spark, d):
    """One boolean case expression by label."""
    r = table(spark, d, "lineitem")
    rule = F.when(F.col("l_returnflag") == "A", ~F.coalesce(F.col("l_quantity") + F.col("l_linenumber") < 20, F.lit(False))).when(
        F.col("l_returnflag") == "N", R.quality_gate(F.col("l_tax") * 50, F.col("l_quantity") / 10, F.col("l_discount") * 10, (1.0, 1.5, 0.2)) & (F.col("l_quantity") >= 9)
    )
    return r.select(*_KEY.split(", "), rule.otherwise(True).alias("admitted"))


@query(f"SELECT {_KEY} FROM (SELECT {_KEY}, {_QAC} FROM lineitem) t WHERE NOT (q < 3 OR a < 4 OR c < 0.5)")
def input_gate(spark, d):
    """Three scores, any of which rejects."""
    r = _line(spark, d)
    return r.where(R.quality_gate(F.col("q"), F.col("a"), F.col("c"), R.INPUT_LEAST["bagel"])).select(*_KEY.split(", "))


@query(f"""SELECT {_KEY} FROM (SELECT {_KEY}, {_QAC}, l_linenumber % 2 AS z FROM lineitem) t
WHERE NOT (a + 1 < 5 OR q + 2 < 3.5 OR q - (q + 2) > 0.2 OR a - (a + 1) > 0.2 OR c - c * z > 0.028)""")
def drop_gate(spark, d):
    """Scores may fall by little."""
    r = _line(spark, d)
    q, a, c, z = F.col("q"), F.col("a"), F.col("c"), F.col("l_linenumber") % 2
    return r.where(R.drop_gate((q, q + 2), (a, a + 1), (c, c * z))).select(*_KEY.split(", "))


@query(f"""SELECT {_KEY} FROM (SELECT {_KEY}, {_QAC} FROM lineitem) t WHERE NOT (abs(q - 1) < 0.02 OR abs(c - 0.5) < 0.008 OR abs(a - 3) < 0.02)""")
def nochange_gate(spark, d):
    """Edits that change next to nothing (F8)."""
    one = lambda v: F.lit(v)
    r = _line(spark, d)
    return r.where(R.change_gate((F.col("q"), one(1.0)), (F.col("a"), one(3.0)), (F.col("c"), one(0.5)))).select(*_KEY.split(", "))


@query(f"""SELECT {_KEY} FROM (SELECT {_KEY}, l_quantity / 50 AS d, 1 - l_discount AS i, l_tax * 4 AS t FROM lineitem) s
WHERE NOT ((d > 0.95 AND i > 0.95) OR d < 0.8 OR i < 0.65 OR t < 0.23 OR d > 0.99 OR i > 0.99)""")
def band_gate(spark, d):
    """Similarity band of subject pairs."""
    r = table(spark, d, "lineitem")
    return r.where(R.subject_band(F.col("l_quantity") / 50, 1 - F.col("l_discount"), F.col("l_tax") * 4)).select(*_KEY.split(", "))


@query(f"""SELECT {_KEY} FROM (SELECT {_KEY}, l_quantity / 50 AS d, 1 - l_discount AS i, l_tax * 4 AS t FROM lineitem) s WHERE NOT (d > 0.95 OR i > 0.95 OR t < 0.2)""")
def style_gate(spark, d):
    """Similarity band of style pairs."""
    r = table(spark, d, "lineitem")
    return r.where(R.style_band(F.col("l_quantity") / 50, 1 - F.col("l_discount"), F.col("l_tax") * 4)).select(*_KEY.split(", "))


@query("SELECT p_partkey, p_size * p_retailprice >= 30000 AS area_ok, p_size >= 20 AND p_retailprice / 50 >= 20 AS side_ok FROM part")
def min_side_area(spark, d):
    """Smallest side and area."""
    p = table(spark, d, "part")
    return p.select("p_partkey", R.area_gate(F.col("p_size"), F.col("p_retailprice"), 30000).alias("area_ok"), R.side_gate(F.col("p_size"), F.col("p_retailprice") / 50, 20).alias("side_ok"))


@query("SELECT doc_id FROM labels WHERE quality + toxic >= 2")
def sum_score_gate(spark, d):
    """Sum of a score list."""
    return table(spark, d, "labels").where(R.score_gate(F.array("quality", "toxic"), 2)).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_size / 20.0 <= 1.3 AND 20.0 / p_size <= 1.3")
def aspect_limit(spark, d):
    """Aspect limit."""
    return table(spark, d, "part").where(R.aspect_ok(F.col("p_size").cast("double"), F.lit(20.0), 1.3)).select("p_partkey")


@query("SELECT o_orderkey, o_orderkey % 5 = 0 OR o_totalprice >= 100000 AS source_ok, CASE WHEN o_totalprice / 500000 BETWEEN 0.02 AND 0.35 THEN 1 ELSE 0 END AS mask_ok FROM orders")
def mask_and_source_gates(spark, d):
    """Area ratio between bounds; a missing score passes (F2, F16)."""
    o = table(spark, d, "orders")
    score = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return o.select("o_orderkey", R.source_gate(score, 100000).alias("source_ok"), R.mask_gate(F.col("o_totalprice") / 500000).cast("int").alias("mask_ok"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_sum(bits)::BIGINT AS area, round(list_sum(bits) / len(bits), 6) AS ratio, list_sum(list_transform(range(1, 11), lambda i: bits[i] * other[i]))::BIGINT AS overlap
FROM (SELECT *, list_transform(range(10), lambda i: CASE WHEN l_quantity::INT % (i + 2) = 0 THEN 1 ELSE 0 END) AS bits, list_transform(range(10), lambda i: CASE WHEN l_partkey % (i + 2) = 0 THEN 1 ELSE 0 END) AS other FROM lineitem) t""")
def mask_statistics(spark, d):
    """Area, ratio and overlap of masks."""
    r = table(spark, d, "lineitem")
    bits = lambda c: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col(c).cast("int") % (i + 2) == 0).cast("int"))
    m = A.mask_stats(bits("l_quantity"), bits("l_partkey"))
    return r.select(*_KEY.split(", "), m["area"].alias("area"), F.round(m["ratio"], 6).alias("ratio"), m["overlap"].alias("overlap"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - l_linenumber) / l_quantity >= 0.8 AS overlap_ok, l_quantity / 1000 >= 0.01 AS region_ok,
CAST(len(list_filter([l_quantity, l_quantity + 20, l_quantity * 2], lambda x: x >= 50)) AS INT) AS large FROM lineitem""")
def overlap_region_gates(spark, d):
    """Overlap share, region share and least contour."""
    r = table(spark, d, "lineitem")
    n = F.col("l_quantity")
    regions = F.transform(F.array(n, n + 20, n * 2), lambda x: F.struct(x.alias("area")))
    return r.select(*_KEY.split(", "), R.overlap_gate(n - F.col("l_linenumber"), n).alias("overlap_ok"), R.region_gate(n, F.lit(1000)).alias("region_ok"), F.size(R.contours(regions)).alias("large"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) <= 2 AS tags_ok, abs(length(p_name) - length(p_type)) <= 3 AS length_ok FROM part")
def tag_length_gates(spark, d):
    """Tag count and text length difference."""
    p = table(spark, d, "part")
    return p.select("p_partkey", R.tag_gate(F.split("p_name", " "), 2).alias("tags_ok"), R.length_gate(F.col("p_name"), F.col("p_type")).alias("length_ok"))


@query("SELECT conv_id, turn, contains(lower(text), 'no') AS has_no, regexp_matches(lower(text), '\\bno\\b') AS word_no FROM conversations")
def yes_no_gate(spark, d):
    """Answers with "no" as letters or as a word."""
    return table(spark, d, "conversations").select("conv_id", "turn", J.answers_no(F.col("text")).alias("has_no"), J.answers_no(F.col("text"), True).alias("word_no"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(list_filter([l_discount, l_tax, l_quantity / 50], lambda x: x > 0.05)) AS INT) AS kept FROM lineitem""")
def detection_filter(spark, d):
    """Detections over a threshold."""
    r = table(spark, d, "lineitem")
    boxes = F.transform(F.array("l_discount", "l_tax", F.col("l_quantity") / 50), lambda x: F.struct(x.alias("box_score"), F.lit(1.0).alias("text_score")))
    return r.select(*_KEY.split(", "), F.size(R.detections(boxes, 0.05, 0.25)).alias("kept"))


# ---------------------------------------------------------------- buckets, batches, mixing

_BUCKET_LIST = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(R.BUCKETS))
_NEAREST = f"""SELECT p_partkey, CAST(arg_min(i, (abs(w::DOUBLE / h - p_size / 20.0::DOUBLE), i)) AS INT) AS bucket_id, round(min(abs(w::DOUBLE / h - p_size / 20.0::DOUBLE)) + 0.0, 6) AS bucket_error
FROM part, (VALUES {_BUCKET_LIST}) b(i, w, h) GROUP BY p_partkey"""


def _with_buckets(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), F.lit(20).alias("h"))
    return R.bucketed(p, "w", "h")


@query(_NEAREST)
def bucket_nearest(spark, d):
    """Nearest of the fixed aspect buckets, first of ties."""
    return _with_buckets(spark, d).select("p_partkey", "bucket_id", F.round("bucket_error", 6).alias("bucket_error"))


@query(f"SELECT p_partkey FROM ({_NEAREST}) t WHERE bucket_error < 0.1")
def bucket_error_gate(spark, d):
    """Rows far from every bucket go."""
    return _with_buckets(spark, d).where(F.round("bucket_error", 6) < 0.1).select("p_partkey")


@query(f"""SELECT bucket_id, CAST(floor(count(*) / 8) AS BIGINT) AS batches, CAST(floor(count(*) / 8) * 8 AS BIGINT) AS rows_kept FROM ({_NEAREST}) t GROUP BY bucket_id HAVING count(*) >= 8""")
def bucket_batches(spark, d):
    """Homogeneous batches of eight; only the last partial batch of a bucket goes."""
    b = M.batches(_with_buckets(spark, d), "bucket_id", 8, "42", "p_partkey")
    per = b.groupBy("bucket_id", "batch").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots")).where("n = 8 AND slots = 8")
    return per.groupBy("bucket_id").agg(F.count("*").alias("batches"), F.sum("n").alias("rows_kept"))


_SHARDED = """WITH o AS (SELECT doc_id, lang, md5('7' || CAST(doc_id AS VARCHAR)) AS o FROM documents),
s AS (SELECT *, ('0x' || substr(o, 25, 8))::BIGINT % 64 AS shard FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, shard ORDER BY o, doc_id) - 1 AS n, count(*) OVER (PARTITION BY lang, shard) AS c FROM s),
full_ AS (SELECT doc_id, lang, lpad(CAST(shard AS VARCHAR), 3, '0') || '-' || lpad(CAST(n // 4 AS VARCHAR), 12, '0') AS batch, CAST(n % 4 AS INT) AS slot FROM n WHERE n < c // 4 * 4),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) - 1 AS m, count(*) OVER (PARTITION BY lang) AS k FROM n WHERE n >= c // 4 * 4),
b AS (SELECT * FROM full_ UNION ALL SELECT doc_id, lang, 'rest-' || lpad(CAST(m // 4 AS VARCHAR), 12, '0'), CAST(m % 4 AS INT) FROM r WHERE m < k // 4 * 4)"""


@query(f"""{_SHARDED}, h AS (SELECT DISTINCT lang, batch FROM b),
w AS (SELECT *, -ln({_u('7', "(lang || '/' || batch)")}) / CASE lang WHEN 'en' THEN 0.6 WHEN 'fr' THEN 0.2 ELSE 0.1 END AS wait FROM h),
p AS (SELECT lang, batch, sum(wait) OVER (PARTITION BY lang ORDER BY batch ROWS UNBOUNDED PRECEDING) AS position FROM w)
SELECT doc_id, lang, batch, slot, round(position, 6) AS position FROM b JOIN p USING (lang, batch)""")
def weighted_mix(spark, d):
    """Batches of languages in an order drawn by weights."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    mixed = M.multiplexed(M.batches(docs, "lang", 4, "7", "doc_id"), "lang", {"en": 0.6, "fr": 0.2, "de": 0.1, "es": 0.1}, "7")
    return mixed.select("doc_id", "lang", "batch", "slot", F.round("position", 6).alias("position"))


@query(f"{_SHARDED} SELECT lang, batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY slot) AS ids FROM b GROUP BY lang, batch")
def collated_batches(spark, d):
    """Rows of a batch as columns of arrays."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    rows = M.collated(M.batches(docs, "lang", 4, "7", "doc_id"), "lang", ["doc_id"])
    return rows.select("lang", "batch", F.array_join(F.transform("doc_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT o_orderkey, CAST(o_orderkey % 3 AS INT) AS node, CAST(o_orderkey // 3 % 4 AS INT) AS worker FROM orders")
def node_worker_shards(spark, d):
    """Rows dealt to nodes, then to the workers of a node (M7, M8)."""
    o = table(spark, d, "orders").select("o_orderkey", M.dealt_twice(F.col("o_orderkey") + 1, 3, 4).alias("x"))
    return o.select("o_orderkey", "x.node", "x.worker")


@query("SELECT o_orderkey, CAST((o_orderkey - 1) % 7 AS INT) AS worker FROM orders WHERE (o_orderkey - 1) % 7 = 3")
def strided_shard(spark, d):
    """Every n-th row for one worker (M7)."""
    o = table(spark, d, "orders").select("o_orderkey", M.round_robin(F.col("o_orderkey"), 7).alias("worker"))
    return M.strided(o, "o_orderkey", 7, 3)


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS INT) AS style FROM orders")
def round_robin(spark, d):
    """Styles in turn."""
    return S.with_rank(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "r").select("o_orderkey", M.round_robin(F.col("r"), 5).alias("style"))


@query("SELECT doc_id, lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 9, '0') AS key FROM documents")
def running_keys(spark, d):
    """Zero-padded running keys."""
    return S.sequence_keys(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS part FROM documents")
def array_split(spark, d):
    """Contiguous near-equal parts."""
    return S.contiguous_split(table(spark, d, "documents").select("doc_id"), 7, ["doc_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def demux_counts(spark, d):
    """Rows dealt to their classes, each class read on its own, the table once (M2)."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).cast("int") - 1
    pipes = M.demultiplexed(table(spark, d, "events"), kind, len(kinds), scratch(spark))
    out = None
    for i, pipe in pipes.items():
        part = pipe.select(F.lit(kinds[i]).alias("event_type"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


_POP = "list_transform({0}, lambda y, q: CASE WHEN q = {1} THEN y[2:] ELSE y END)"


@query(f"""WITH RECURSIVE items AS (
    SELECT doc_id % 8 AS g, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS p, doc_id, list_position(['de', 'en', 'es', 'fr'], lang) AS k FROM documents WHERE lang IS NOT NULL
), steps AS (
    SELECT DISTINCT g, CAST(0 AS BIGINT) AS p, CAST(1 AS BIGINT) AS c, [[], [], [], []]::BIGINT[][] AS b, CAST(0 AS BIGINT) AS place, NULL::BIGINT AS doc_id, NULL::BIGINT AS child, false AS handed_over FROM items
    UNION ALL
    SELECT g, CASE WHEN own OR item IS NULL THEN p ELSE p + 1 END, CASE WHEN own OR item IS NULL OR k = c OR full_ THEN c % 4 + 1 ELSE c END,
        CASE WHEN own THEN {_POP.format("b", "c")} WHEN item IS NULL OR k = c THEN b WHEN full_ THEN {_POP.format("b2", "biggest")} ELSE b2 END,
        CASE WHEN own OR (item IS NOT NULL AND (k = c OR full_)) THEN place + 1 ELSE place END,
        CASE WHEN own THEN b[c][1] WHEN item IS NULL THEN NULL WHEN k = c THEN item WHEN full_ THEN b2[biggest][1] END,
        CASE WHEN own OR (item IS NOT NULL AND (k = c OR full_)) THEN c - 1 END, NOT own AND item IS NOT NULL AND k <> c AND full_ AND biggest <> c
    FROM (SELECT *, len(flatten(b2)) > 8 AS full_, list_position(list_transform(b2, lambda x: len(x)), list_max(list_transform(b2, lambda x: len(x)))) AS biggest
        FROM (SELECT s.g, s.p, s.c, s.b, s.place, len(s.b[s.c]) > 0 AS own, i.doc_id AS item, i.k,
                list_transform(s.b, lambda x, j: CASE WHEN j = i.k THEN list_append(x, i.doc_id) ELSE x END) AS b2
            FROM steps s LEFT JOIN items i ON i.g = s.g AND i.p = s.p + 1 WHERE i.doc_id IS NOT NULL OR len(flatten(s.b)) > 0) x) y
)
SELECT doc_id, CAST(child AS INT) AS child, place - 1 AS place, handed_over FROM steps WHERE doc_id IS NOT NULL""")
def demux_replay(spark, d):
    """Children that ask in turn, what others will ask for parked in bounded buffers, the largest handed over when they are full (M2)."""
    docs = table(spark, d, "documents").select("doc_id", "lang").where("lang IS NOT NULL")
    kind = F.array_position(F.array(*map(F.lit, ["de", "en", "es", "fr"])), F.col("lang")) - 1
    found = DX.demultiplexed(docs, F.col("doc_id") % 8, ["doc_id"], kind, 4, per_class=2)
    return found.select("doc_id", "child", "place", "handed_over")


# Kinds of instructions that the next query chooses from.
_KINDS = ["add", "remove", "replace", "style", "text", "background"]


@query(f"""WITH RECURSIVE items AS (SELECT doc_id % 8 AS g, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS p, doc_id FROM documents),
steps AS (
    SELECT DISTINCT g, CAST(0 AS BIGINT) AS p, NULL::BIGINT AS doc_id, []::VARCHAR[] AS ring, []::VARCHAR[] AS picked FROM items
    UNION ALL
    SELECT g, p, doc_id, list_concat(ring, picked)[greatest(1, len(ring) + len(picked) - 29):], picked
    FROM (SELECT s.g, i.p, i.doc_id, s.ring,
            list_transform(list_sort(list_transform({_KINDS}, lambda t: {{'w': -ln(({"(('0x' || substr(md5('0/' || s.g || '/' || i.doc_id || '/' || t), 1, 8))::BIGINT + 1)"}) / 4294967297.0)
                / greatest(1 - len(list_filter(s.ring, lambda x: x = t)) / greatest(len(s.ring), 1)::DOUBLE, 1e-6), 't': t}}))[1:3], lambda x: x.t) AS picked
        FROM steps s JOIN items i ON i.g = s.g AND i.p = s.p + 1) y
)
SELECT doc_id, array_to_string(picked, ',') AS chosen FROM steps WHERE doc_id IS NOT NULL""")
def balanced_choices(spark, d):
    """Three kinds for each row, drawn against the shares of the last thirty choices."""
    docs = table(spark, d, "documents").select("doc_id")
    found = BA.balanced_choices(docs, F.col("doc_id") % 8, "doc_id", _KINDS, 3, 30)
    return found.select("doc_id", F.array_join("chosen", ",").alias("chosen"))


# ---------------------------------------------------------------- sampling

@query(f"SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln({_u('w', 'doc_id')}) / n_chars, doc_id LIMIT 20")
def weighted_sample(spark, d):
    """Twenty rows drawn in proportion to a weight, without replacement."""
    return S.weighted_sample(table(spark, d, "documents"), "w", "doc_id", F.col("n_chars"), 20).select("doc_id")


@query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY -ln({_u('w', "(l_orderkey || '-' || l_linenumber)")}) / l_quantity, l_orderkey || '-' || l_linenumber) AS rn, count(*) OVER () AS n FROM lineitem) t
WHERE rn <= n // 20""")
def weighted_sample_large(spark, d):
    """A twentieth of a table drawn in proportion to a weight, without replacement."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keyed = rows.withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return S.weighted_sample(keyed, "w", "k", F.col("l_quantity"), rows.count() // 20).select("l_orderkey", "l_linenumber")


@query(f"SELECT doc_id, {_u('c', 'doc_id')} < 0.3 AS heads FROM documents")
def bernoulli_coin(spark, d):
    """A hashed coin."""
    return table(spark, d, "documents").select("doc_id", S.coin("c", F.col("doc_id"), 0.3).alias("heads"))


@query(f"SELECT doc_id, CASE WHEN {_u('s', 'doc_id')} < 0.9 THEN 'train' ELSE 'val' END AS part FROM documents")
def hash_split(spark, d):
    """Train and validation by hash."""
    return table(spark, d, "documents").select("doc_id", S.split_by_hash("s", F.col("doc_id"), {"train": 0.9, "val": 0.1}).alias("part"))


@query(f"""SELECT doc_id, CAST(len(list_distinct([w[{_i('d0', 'doc_id', 'len(w)')} + 1], w[{_i('d1', 'doc_id', 'len(w)')} + 1], w[{_i('d2', 'doc_id', 'len(w)')} + 1]])) AS INT) AS kept
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) t""")
def k_draws_dedup(spark, d):
    """Three draws with replacement from a text's words, repeats dropped."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return docs.select("doc_id", F.size(S.draws_with_replacement("d", F.col("doc_id"), F.col("w"), 3)).alias("kept"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(range(len(w)), lambda i: {'o': md5('e' || CAST(p_partkey AS VARCHAR) || '/' || CAST(i AS VARCHAR)), 'v': w[i + 1]}))[1:2], lambda s: s.v), ' ') AS words
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) t""")
def sample_entries(spark, d):
    """min(n, size) entries without replacement."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return p.select("p_partkey", F.array_join(S.draws_without_replacement("e", F.col("p_partkey"), F.col("w"), 2), " ").alias("words"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS BIGINT) AS place FROM documents")
def shuffled_order(spark, d):
    """A seeded order (T6, M6): the place of each row in it."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string"))).alias("h"))
    prefix = docs.withColumn("p", F.conv(F.substring("h", 1, 8), 16, 10).cast("long"))
    return S.with_rank(prefix, ["p", "h", "doc_id"], "place").select("doc_id", "place")


@query(f"SELECT doc_id, CASE WHEN {_u('capblank', 'doc_id')} < 0.1 THEN ' ' ELSE [lang, source, 'x'][{_i('cap', 'doc_id', '3')} + 1] END AS caption FROM documents")
def caption_choice(spark, d):
    """One of several captions, a tenth blank."""
    return table(spark, d, "documents").select("doc_id", S.caption_choice("cap", F.col("doc_id"), F.array("lang", "source", F.lit("x"))).alias("caption"))


@query(f"SELECT p_partkey, CAST(16 * (8 + {_i('r', 'p_partkey', '25')}) AS INT) AS side, CAST(CASE WHEN p_size > 10 THEN {_i('o', 'p_partkey', 'p_size - 10 + 1')} ELSE 0 END AS INT) AS crop_at FROM part")
def random_sizes(spark, d):
    """Random resolutions and crop offsets."""
    p = table(spark, d, "part")
    return p.select("p_partkey", S.random_side("r", F.col("p_partkey"), 8, 32).alias("side"), S.crop_offset("o", F.col("p_partkey"), F.col("p_size"), F.lit(10)).alias("crop_at"))


# ---------------------------------------------------------------- top-k and windows

@query(f"SELECT {_KEY}, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {_KEY}) AS rn FROM lineitem) t WHERE rn <= 3")
def topk_per_group(spark, d):
    """The three largest of each group (T4)."""
    order = [F.col("l_extendedprice").desc(), *map(F.col, _KEY.split(", "))]
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    return table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select(*_KEY.split(", "), "l_extendedprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) t WHERE rn <= 2")
def newest_n_retention(spark, d):
    """The newest two of each group by numeric suffix."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return L.newest(o.withColumn("step", L.step_number(F.col("name"))), ["o_custkey"], "step", 2, "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.06 GROUP BY l_orderkey")
def first_passing_candidate(spark, d):
    """The first candidate that passes."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"))
    return L.first_passing(r, ["l_orderkey"], "o", (F.col("l_discount") > 0.05) & (F.col("l_tax") < 0.06)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, max(l_quantity) AS area, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def max_area_region(spark, d):
    """The largest region, first of ties."""
    r = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("area"), F.col("l_linenumber").alias("n"), "l_linenumber")
    return A.largest_region(r, ["l_orderkey"], "area", "n", "l_linenumber").select("l_orderkey", "area", "l_linenumber")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events)
SELECT a.event_id, round(count(*) FILTER (b.event_type = a.event_type) / count(*), 6) AS share
FROM r a JOIN r b ON b.n BETWEEN a.n - 99 AND a.n GROUP BY a.event_id""")
def rolling_type_share(spark, d):
    """Share of a row's kind among the last hundred."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return A.rolling_share(e, ["event_id"], "event_type", 100).select("event_id", F.round("share", 6).alias("share"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(1 - count(*) / (SELECT count(*) FROM events), 6) AS weight FROM events GROUP BY event_type")
def type_proportions(spark, d):
    """Counts, shares and inverse-frequency weights."""
    f = S.inverse_frequency(table(spark, d, "events"), "event_type")
    return f.select("event_type", "n", F.round("share", 6).alias("share"), F.round("weight", 6).alias("weight"))


@query("SELECT CAST(coalesce(min(n), 1) AS BIGINT) AS next FROM (SELECT range AS n FROM range(1, 2000)) t WHERE n NOT IN (SELECT o_custkey FROM orders)")
def next_free_number(spark, d):
    """The smallest free sequence number of a range that starts over at 1 (K9)."""
    return L.next_free(table(spark, d, "orders"), "o_custkey", below=2000)


# ---------------------------------------------------------------- JSON and judge answers

@query("SELECT event_id, k AS name, CAST(json_extract_string(props, '$.' || k) AS VARCHAR) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) t WHERE json_extract_string(props, '$.' || k) IS NOT NULL AND json_extract_string(props, '$.' || k) <> ''")
def explode_instructions(spark, d):
    """A JSON dictionary to rows, empty values dropped."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    kept = F.map_filter("m", lambda k, v: v.isNotNull() & (v != ""))
    return e.select("event_id", F.explode(kept).alias("name", "v"))


@query("SELECT event_id, coalesce(json_extract(props, '$.k') IS NOT NULL, false) AS has_k, coalesce(json_extract(props, '$.zz') IS NOT NULL, false) AS has_zz FROM events")
def json_haskey(spark, d):
    """Whether a JSON object has a key."""
    return table(spark, d, "events").select("event_id", J.has_key(F.col("props"), "k").alias("has_k"), J.has_key(F.col("props"), "zz").alias("has_zz"))


# Judges' answers about the turns of conversations: one form for each kind, with two scores a (0 to 12) and b (0 to 10).
_JUDGED = "SELECT conv_id, turn, conv_id % 13 AS a, (conv_id + turn) % 11 AS b, CAST((conv_id * 3 + turn) % 12 AS INT) AS kind, md5(text) AS said FROM conversations"
_N = "CAST({} AS STRING)".format
_A, _B = _N("a"), _N("b")
_PAIR = f"'[' || {_A} || ', ' || {_B} || ']'"
_ANSWER = f"""CASE kind WHEN 0 THEN 'Score 1: ' || {_A} || chr(10) || 'Score 2: ' || {_B} || chr(10) || 'remark: none'
WHEN 1 THEN {_PAIR} || ' ok' WHEN 2 THEN 'scores [ ' || {_A} || ' ,' || {_B} || ' ] then [9, 9]' WHEN 3 THEN '{{"score": ' || {_PAIR} || ', "reasoning": "' || said || '"}}'
WHEN 4 THEN '{{"score": ' || {_A} || ', "reasoning": "x, y"}}' WHEN 5 THEN {_PAIR} WHEN 6 THEN {_A}
WHEN 7 THEN said || ' ||V^=^V||{{"score": ' || {_PAIR} || ', "reasoning": "d"}}||V^=^V||' WHEN 8 THEN said || ' ```json' || chr(10) || '{{"k": ' || {_A} || '}}' || chr(10) || '``` end'
WHEN 9 THEN 'Edit score: ' || {_A} || ' (good)' || chr(10) || 'Quality score: ' || {_B} || chr(10) || 'remark: none'
WHEN 10 THEN '[score1: ' || {_A} || ', score2: ' || {_B} || ']' ELSE 'rate_limit_exceeded' END"""


def _answers(spark, d):
    """Rows (conv_id, turn, answer)."""
    t = table(spark, d, "conversations")
    judged = t.select("conv_id", "turn", (F.col("conv_id") % 13).alias("a"), ((F.col("conv_id") + F.col("turn")) % 11).alias("b"), ((F.col("conv_id") * 3 + F.col("turn")) % 12).cast("int").alias("kind"), F.md5("text").alias("said"))
    return judged.select("conv_id", "turn", F.expr(_ANSWER).alias("answer"))


_LISTED = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""SELECT conv_id, turn, CASE WHEN kind = 0 THEN {_A} || ',' || {_B} ELSE '' END AS numbered,
CASE WHEN kind IN (1, 2, 3, 5, 7) THEN {_A} || ',' || {_B} END AS pair, CASE WHEN kind = 8 THEN chr(10) || '{{"k": ' || {_A} || '}}' || chr(10) END AS fenced FROM ({_JUDGED}) t""")
def score_regex(spark, d):
    """Numbered scores, pairs and fenced JSON."""
    answer = F.col("answer")
    return _answers(spark, d).select("conv_id", "turn", _LISTED(J.numbered_scores(answer)).alias("numbered"), _LISTED(J.score_pair(answer)).alias("pair"), J.fenced_json(answer).alias("fenced"))


@query(f"""SELECT conv_id, turn, CASE WHEN kind IN (1, 3, 5, 7) THEN {_A} || '.0,' || {_B} || '.0' WHEN kind = 4 OR (kind = 6 AND a <= 10) THEN {_A} || '.0' END AS score,
CASE kind WHEN 3 THEN said WHEN 4 THEN 'x, y' WHEN 7 THEN 'd' END AS reasoning FROM ({_JUDGED}) t""")
def judge_parse(spark, d):
    """Tolerant answers by the first rule that holds; nothing is guessed."""
    parsed = J.parse_answer(F.col("answer"))
    return _answers(spark, d).select("conv_id", "turn", _LISTED(parsed["score"]).alias("score"), parsed["reasoning"].alias("reasoning"))


def _readable(kind: str) -> str:
    return f"({kind} IN (1, 3, 4, 5, 7) OR ({kind} = 6 AND a <= 10))"


_SCORE = f"CASE WHEN {{0}} IN (1, 3, 5, 7) THEN {_A} || '.0,' || {_B} || '.0' ELSE {_A} || '.0' END"


@query(f"""SELECT conv_id, turn, CASE WHEN kind = 11 OR again = 11 THEN NULL WHEN {_readable("kind")} THEN {_SCORE.format("kind")} WHEN {_readable("again")} THEN {_SCORE.format("again")}
ELSE CAST(('0x' || substr(md5('g' || conv_id || '/' || turn), 1, 8))::BIGINT % 11 AS VARCHAR) || '.0' END AS score,
CASE WHEN kind = 11 OR again = 11 THEN NULL ELSE NOT {_readable("kind")} AND NOT {_readable("again")} END AS guessed FROM (SELECT *, (kind + 5) % 12 AS again FROM ({_JUDGED}) t) u""")
def judge_two_passes(spark, d):
    """A second answer where the first can't be read, and a marked guess where neither can."""
    t = table(spark, d, "conversations")
    judged = t.select("conv_id", "turn", (F.col("conv_id") % 13).alias("a"), ((F.col("conv_id") + F.col("turn")) % 11).alias("b"), ((F.col("conv_id") * 3 + F.col("turn")) % 12).cast("int").alias("kind"), F.md5("text").alias("said"))
    asked = judged.withColumn("first", F.expr(_ANSWER)).withColumn("kind", (F.col("kind") + 5) % 12).withColumn("second", F.expr(_ANSWER))
    found = J.parse_two(F.col("first"), F.col("second"), "g", F.concat_ws("/", "conv_id", "turn"))
    return asked.select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", _LISTED(F.col("f.score")).alias("score"), F.col("f.guessed").alias("guessed"))


@query(f"SELECT conv_id, turn, kind = 6 AND a <= 10 AS is_score, kind = 5 AND a <= 10 AS is_list, kind = 10 AND a <= 10 AS is_named, kind = 7 AS is_delimited FROM ({_JUDGED}) t")
def score_validators(spark, d):
    """Format checks."""
    c = F.col("answer")
    return _answers(spark, d).select("conv_id", "turn", J.is_score(c).alias("is_score"), J.is_score_list(c).alias("is_list"), J.is_named_scores(c).alias("is_named"), J.delimited(c).alias("is_delimited"))


@query(f"SELECT conv_id, turn, CASE WHEN kind IN (0, 9) THEN {_A} || '.0,' || {_B} || '.0' ELSE '' END AS scores FROM ({_JUDGED}) t")
def line_score_parse(spark, d):
    """Values of lines that split in two."""
    return _answers(spark, d).select("conv_id", "turn", _LISTED(J.line_scores(F.col("answer"))).alias("scores"))


@query(f"""SELECT conv_id, turn, CASE kind % 3 WHEN 0 THEN '{{"score": [' || {_A} || '], "reasoning": "good, ' || said || '"}}' WHEN 1 THEN '{{"score": [' || {_A} || ', ' || {_B} || '], "ok": true}}' END AS fixed FROM ({_JUDGED}) t""")
def relaxed_json(spark, d):
    """Relaxed JSON made strict."""
    t = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 13).alias("a"), ((F.col("conv_id") + F.col("turn")) % 11).alias("b"), ((F.col("conv_id") * 3 + F.col("turn")) % 12).alias("kind"), F.md5("text").alias("said"))
    loose = F.expr(f"""CASE kind % 3 WHEN 0 THEN '{{score: ' || {_A} || ', reasoning: good, ' || said || '}}' WHEN 1 THEN '{{"score": ' || {_PAIR} || ', ok: True}}' ELSE 'no json' END""")
    return t.select("conv_id", "turn", J.repair_json(loose).alias("fixed"))


@query("SELECT * FROM (VALUES (0, 'Add a hat', 'en', '5.0,4.0'), (2, '改成蓝色', 'ch', '3.0,3.0'), (3, 'X改', 'en', '2.0,4.0')) t(line_no, instruction, lang, score)")
def score_log_lines(spark, d):
    """Valid lines of a score log, the first of equal instructions (S17, F28); see score_log_files for whole files."""
    lines = ["Add a hat\t[5, 4]", "Add a hat\t[1, 1]", "改成蓝色\t[3, 3]", "X改\t[2, 4]", "final score: [3.0, 3.0, 6.0]", "broken line"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    parsed = L.first_wins(FS.parse_score_lines(rows), ["file", "instruction"], ["line_no"])
    return parsed.select(F.col("line_no").cast("int").alias("line_no"), "instruction", X.script_language(F.col("instruction")).alias("lang"), F.array_join(F.transform("score", lambda x: x.cast("string")), ",").alias("score"))


# ---------------------------------------------------------------- text

@query(r"""SELECT doc_id, md5(lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g'))) AS plain, md5(replace(replace(replace(text, chr(10), ''), '```json', ''), '```', '')) AS unfenced,
lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) <> lower(regexp_replace(lang, '[^a-zA-Z0-9]', '', 'g')) AS differs FROM documents""")
def text_normalise(spark, d):
    """Letters and digits only; fences and line ends removed; inequality."""
    rows = table(spark, d, "documents").select("doc_id", X.normalised(F.col("text")).alias("own"), X.normalised(F.col("lang")).alias("other"), X.unfenced(F.col("text")).alias("unfenced"))
    return rows.select("doc_id", F.md5("own").alias("plain"), F.md5("unfenced").alias("unfenced"), (F.col("own") != F.col("other")).alias("differs"))


@query(r"SELECT doc_id, regexp_matches(text, '[a-zA-Z]') AS latin, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS han, regexp_matches(text, '[\x{4e00}-\x{9fa5}]') AS han_narrow, CASE WHEN length(text) = 0 THEN NULL ELSE 'en' END AS lang_class FROM documents")
def contains_script(spark, d):
    """Scripts that a text has."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.has_latin(t).alias("latin"), X.has_han(t).alias("han"), X.has_han_narrow(t).alias("han_narrow"), X.script_language(t).alias("lang_class"))


@query("""SELECT page_id, regexp_extract_all(html, '["“”]([^"“”]*)["“”]', 1)[-1] AS last, regexp_extract_all(html, '["“”]([^"“”]*)["“”]', 1)[-2] AS second_last FROM pages""")
def quoted_substring(spark, d):
    """Last quoted substrings."""
    return table(spark, d, "pages").select("page_id", X.quoted(F.col("html")).alias("last"), X.quoted(F.col("html"), 2).alias("second_last"))


@query(r"""SELECT doc_id, CAST(len(s) AS INT) AS n, regexp_replace(s[1], '\.\s$', '') AS first FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][A-Z\-0-9]*[^\n]*?(?:\.\s|$)') AS s FROM documents) t""")
def sentences(spark, d):
    """Stretches from a capital to a full stop."""
    rows = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


@query("SELECT p_partkey, contains(p_name, string_split(p_name, ' ')[1]) AS found, replace('Change <color> of <thing>', '<color>', p_type) AS half, replace(replace('Change <color> of <thing>', '<color>', p_type), '<thing>', p_name) AS prompt FROM part")
def template_and_ocr(spark, d):
    """Templates filled, text found in text."""
    p = table(spark, d, "part")
    tpl = F.lit("Change <color> of <thing>")
    return p.select("p_partkey", F.contains("p_name", F.split("p_name", " ")[0]).alias("found"), X.fill_template(tpl, color=F.col("p_type")).alias("half"), X.fill_template(tpl, color=F.col("p_type"), thing=F.col("p_name")).alias("prompt"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g'))) AS canonical FROM documents""")
def canonical_text(spark, d):
    """Punctuation removed, white space folded."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.canonical(F.col("text"))).alias("canonical"))


@query("""SELECT p_partkey, array_to_string(string_split(p_type, ''), '  ') AS spaced, CASE WHEN trim(lower(p_name)) LIKE '%.' THEN trim(lower(p_name)) ELSE trim(lower(p_name)) || '.' END AS caption,
'''' || array_to_string(string_split(p_name, ' '), ''', ''') || '''' AS quoted FROM part""")
def caption_forms(spark, d):
    """Spaced letters, closed captions, quoted words."""
    p = table(spark, d, "part")
    return p.select("p_partkey", X.spaced(F.col("p_type"), 2).alias("spaced"), X.caption(F.col("p_name")).alias("caption"), X.quote_words(F.split("p_name", " ")).alias("quoted"))


@query("SELECT c_custkey, 'Delete ' || c_mktsegment || ' in the picture' AS removal, 'Convert the image to a ' || replace(string_split(c_name, '_rank')[1], '_', ' ') || ' style' AS style, string_split(c_name, '#')[-1] AS tail FROM customer")
def instruction_builders(spark, d):
    """Instruction texts, style names, last path segments."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("Delete "), "c_mktsegment", F.lit(" in the picture")).alias("removal"), F.concat(F.lit("Convert the image to a "), X.style_name(F.col("c_name")), F.lit(" style")).alias("style"), F.element_at(F.split("c_name", "#"), -1).alias("tail"))


@query("SELECT doc_id, md5('data:image/png;base64,' || base64(encode(text))) AS url FROM documents")
def data_url(spark, d):
    """Base64 data URLs of whole payloads, as digests."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.data_url(F.col("text").cast("binary"))).alias("url"))


@query("SELECT page_id, string_split(string_split(html, '</title>')[1], '<title>')[2] AS title, array_to_string(list_transform(string_split(url, '/'), lambda x: trim(x)), '|') AS parts FROM pages")
def between_markers(spark, d):
    """Text between markers; trimmed parts."""
    return table(spark, d, "pages").select("page_id", X.between(F.col("html"), "<title>", "</title>").alias("title"), F.array_join(X.parts(F.col("url"), "/"), "|").alias("parts"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN repeat('x', CAST(156 + doc_id % 7 AS INT)) || '"|“' || substr(lang, 1, 1) || '”|“' || substr(lang, 2, 1) || '”|" ' || source WHEN 1 THEN 'a "' || lang || '" ' || source ELSE '' END AS pieces FROM documents""")
def prompt_pieces(spark, d):
    """Quote-aware prompt split."""
    prompt = F.expr("""CASE doc_id % 3 WHEN 0 THEN repeat('x', CAST(156 + doc_id % 7 AS INT)) || '"' || lang || '" ' || source WHEN 1 THEN 'a "' || lang || '" ' || source ELSE '' END""")
    return table(spark, d, "documents").select("doc_id", F.array_join(X.split_prompt(prompt), "|").alias("pieces"))


# ---------------------------------------------------------------- geometry

@query("""SELECT p_partkey, CAST(round_even(p_size / 16.0, 0) * 16 AS INT) AS m16, CAST(CASE WHEN p_size % 8 >= 4 THEN p_size + 8 - p_size % 8 ELSE p_size - p_size % 8 END AS INT) AS m8,
CAST(ceil(p_size / 32.0) * 32 AS INT) AS up32, CAST(floor(p_retailprice / 32.0) * 32 AS INT) AS down32, CASE WHEN p_size > 25 THEN 'horizontal' ELSE 'vertical' END AS direction FROM part""")
def round_dims(spark, d):
    """Roundings and the merge direction."""
    p = table(spark, d, "part")
    n, r = F.col("p_size"), F.col("p_retailprice")
    return p.select("p_partkey", G.multiple_of_16(n).alias("m16"), G.multiple_of_8(n).alias("m8"), G.ceil_to(n, 32).alias("up32"), G.floor_to(r, 32).alias("down32"), G.concat_direction(n, F.lit(25)).alias("direction"))


@query("""WITH t AS (SELECT p_partkey, p_size * 10 AS w, CAST(floor(p_retailprice) AS INT) AS h FROM part), s AS (SELECT *, w::DOUBLE / h AS r FROM t)
SELECT p_partkey, CAST(floor((CASE WHEN w > h THEN ceil(sqrt(262144.0 * r)) ELSE ceil(ceil(sqrt(262144.0 / r)) * r) END) / 16) * 16 AS INT) AS aw,
CAST(floor((CASE WHEN w > h THEN ceil(ceil(sqrt(262144.0 * r)) / r) ELSE ceil(sqrt(262144.0 / r)) END) / 16) * 16 AS INT) AS ah,
CAST(CASE WHEN floor(w * 512 / h::DOUBLE) >= 512 THEN floor(w * 512 / h::DOUBLE) ELSE 512 END AS INT) AS sw, CAST(CASE WHEN floor(w * 512 / h::DOUBLE) >= 512 THEN 512 ELSE floor(h * 512 / w::DOUBLE) END AS INT) AS sh FROM s""")
def resize_dims(spark, d):
    """Resizes by area and by the shorter side."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), F.floor("p_retailprice").cast("int").alias("h"))
    area, side = G.area_resize(F.col("w"), F.col("h")), G.shorter_side_resize(F.col("w"), F.col("h"))
    return p.select("p_partkey", area["w"].alias("aw"), area["h"].alias("ah"), side["w"].alias("sw"), side["h"].alias("sh"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_discount - l_tax / 2) * 640, 4) + 0.0 AS x0, round((l_discount + l_tax / 2) * 640, 4) + 0.0 AS x1 FROM lineitem""")
def box_transform(spark, d):
    """Centre form to corners."""
    r = table(spark, d, "lineitem")
    b = G.box_corners(F.col("l_discount"), F.col("l_discount"), F.col("l_tax"), F.col("l_tax"), F.lit(640), F.lit(480))
    return r.select(*_KEY.split(", "), (F.round(b["x0"], 4) + 0.0).alias("x0"), (F.round(b["x1"], 4) + 0.0).alias("x1"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * p_size < 1024 THEN 0 WHEN p_size * p_size < 2000 THEN 1 ELSE 2 END AS INT) AS band, CAST(CASE WHEN p_size * 300 < 1024 THEN 0 WHEN p_size * 300 < 9216 THEN 1 ELSE 2 END AS INT) AS coco FROM part")
def area_bands(spark, d):
    """Small, medium and large objects."""
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(n * n < 1024, 0).when(n * n < 2000, 1).otherwise(2).alias("band"), G.area_band(n * 300).alias("coco"))


@query("SELECT s_suppkey, round(s_acctbal * 0.5 + 3, 6) AS x, CAST(s_suppkey % 3 + s_suppkey % 5 + 20 AS INT) AS w, CAST(floor((s_nationkey + 10) / 2.0) AS INT) AS h FROM supplier")
def merge_geometry(spark, d):
    """Side-by-side sizes and de-normalisation."""
    s = table(spark, d, "supplier")
    m = G.merged_size(F.array(F.col("s_suppkey") % 3, F.col("s_suppkey") % 5, F.lit(0)), F.array(F.col("s_nationkey"), F.lit(10)))
    return s.select("s_suppkey", F.round(G.denormalised(F.col("s_acctbal"), F.lit(3), F.lit(0.5)), 6).alias("x"), m["w"].alias("w"), m["h"].alias("h"))


# ---------------------------------------------------------------- vectors and metrics

_COS = "(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"


@query(f"SELECT a.vec_id, round({_COS}, 6) AS cosine, round(({_COS} + 1) / 2, 6) AS share FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    """Cosines of paired vectors."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(V.cosine_share(F.col("embedding"), F.col("other")), 6).alias("share"))


@query("""WITH u AS (SELECT vec_id, vec_id // 400 AS batch, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) t),
p AS (SELECT a.batch, a.vec_id, sum(CASE WHEN a.label = b.label AND a.vec_id <> b.vec_id THEN e ELSE 0 END) AS same, sum(e) AS total FROM (
  SELECT a, b, exp(-greatest(0, 2 - 2 * list_dot_product(a.v, b.v)) / 0.5) AS e FROM u a JOIN u b ON a.batch = b.batch) t GROUP BY a.batch, a.vec_id)
SELECT CAST(batch AS BIGINT) AS batch, round(avg(-ln((same + 1e-8) / (total + 1e-8))), 5) AS loss, count(*) AS n FROM p GROUP BY batch""")
def dispersive_loss(spark, d):
    """Dispersive loss of each training batch of four hundred vectors."""
    e = table(spark, d, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 400))
    return A.dispersive_loss(e, "embedding", "label", "vec_id", "batch").select("batch", F.round("loss", 5).alias("loss"), "n")


@query("""SELECT vec_id, round(list_max(list_transform(embedding, lambda x: exp(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS p, round(list_sum(list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE)))), 5) AS s,
round(list_sum(list_transform(range(1, 33), lambda i: 0.7 * embedding[i]::DOUBLE + 0.3 * embedding[i + 32]::DOUBLE)), 5) + 0.0 AS mix, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE) ** 2)), 5) AS d2 FROM embeddings""")
def vector_maths(spark, d):
    """Softmax, sigmoid, interpolation, squared distance over whole vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("e"))
    low, high = F.slice("e", 1, 32), F.slice("e", 33, 32)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return rows.select("vec_id", F.round(F.array_max(V.softmax(F.col("e"))), 6).alias("p"), F.round(total(F.transform("e", V.sigmoid)), 5).alias("s"), (F.round(total(V.interpolated(low, high, F.lit(0.3))), 5) + 0.0).alias("mix"), F.round(V.squared_distance(low, high), 5).alias("d2"))


@query("SELECT CAST(l_linenumber AS INT) AS expert, count(*) AS tokens, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS load, round(avg(l_discount), 6) AS mean_prob, CAST(sum(count(*)) OVER (ORDER BY l_linenumber) - count(*) AS BIGINT) AS offset FROM lineitem GROUP BY l_linenumber")
def expert_load(spark, d):
    """Load, mean gate and offsets by expert."""
    r = A.expert_load(table(spark, d, "lineitem"), "l_linenumber", "l_discount")
    return r.select(F.col("l_linenumber").alias("expert"), "tokens", F.round("load", 6).alias("load"), F.round("mean_prob", 6).alias("mean_prob"), F.col("offset").cast("long").alias("offset"))


@query("""SELECT vec_id, CAST(s[1].i AS INT) AS first, round(-s[1].p, 6) AS p1, CAST(s[2].i AS INT) AS second, round(-s[1].p * 2 - s[2].p * 3, 6) AS mixed FROM (
SELECT vec_id, list_sort(list_transform(range(1, len(embedding) + 1), lambda k: {'p': -(embedding[k]::DOUBLE), 'i': k - 1})) AS s FROM embeddings) t""")
def top_experts(spark, d):
    """Top-two gates of all and their weighted sum."""
    rows = table(spark, d, "embeddings").select("vec_id", A.top_experts(V.as_double(F.col("embedding")), 2).alias("t"))
    return rows.select("vec_id", F.col("t")[0]["expert"].alias("first"), F.round(F.col("t")[0]["prob"], 6).alias("p1"), F.col("t")[1]["expert"].alias("second"), F.round(F.col("t")[0]["prob"] * 2 + F.col("t")[1]["prob"] * 3, 6).alias("mixed"))


_AP = """WITH r AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, row_number() OVER w AS k, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS h
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))
SELECT l_suppkey, sum(CASE WHEN y = 1 THEN h::DOUBLE / k ELSE 0 END) / (sum(y) + 1e-8) AS ap FROM r GROUP BY l_suppkey"""


def _aps(spark, d):
    r = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"))
    return A.average_precision(r, ["l_suppkey"], "l_extendedprice", "y", "k")


@query(f"SELECT l_suppkey, round(ap, 6) AS ap FROM ({_AP}) t")
def average_precision(spark, d):
    """AP by group."""
    return _aps(spark, d).select("l_suppkey", F.round("ap", 6).alias("ap"))


@query(f"SELECT round(100 * avg(ap), 5) AS map FROM ({_AP}) t")
def mean_average_precision(spark, d):
    """Mean AP (A9)."""
    return A.mean_average_precision(_aps(spark, d)).select(F.round("map", 5).alias("map"))


@query("SELECT event_type, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS mean FROM events GROUP BY event_type")
def running_mean(spark, d):
    """Weighted running mean (A10)."""
    e = table(spark, d, "events").withColumn("n", F.col("event_id") % 5 + 1)
    return e.groupBy("event_type").agg(F.round(A.running_mean("value", "n"), 6).alias("mean"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(CASE WHEN k = 1 THEN 1.0 ELSE 0.01 END * pow(0.99, n - k) * value), 6) AS ema FROM r GROUP BY event_type""")
def ema(spark, d):
    """Exponential average in order of time."""
    return A.ema(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value").select("event_type", F.round("ema", 6).alias("ema"))


@query("""SELECT doc_id, round(CASE WHEN i = 10 THEN 0 ELSE exp(mu) / (exp(mu) + (1 / (1 - i / 10.0) - 1)) END, 6) AS t, CAST(i AS INT) AS step FROM (
SELECT doc_id, i, (256 + n_chars % 3840) * (0.65::DOUBLE / 3840) + (0.5 - (0.65::DOUBLE / 3840) * 256) AS mu FROM documents, range(11) b(i)) x""")
def timestep_schedule(spark, d):
    """Shifted time schedules, one for each length."""
    rows = table(spark, d, "documents").select("doc_id", (256 + F.col("n_chars") % 3840).alias("n"))
    return rows.select("doc_id", F.posexplode(V.schedule(10, F.col("n"))).alias("step", "t")).select("doc_id", F.round("t", 6).alias("t"), "step")


@query("SELECT doc_id, CAST(i AS INT) AS i, round(CASE WHEN i < 4 THEN sin(doc_id / pow(10000.0, i / 4.0)) ELSE cos(doc_id / pow(10000.0, (i - 4) / 4.0)) END, 6) AS v FROM documents, range(8) b(i)")
def sincos_embedding(spark, d):
    """Sine and cosine position embeddings."""
    rows = table(spark, d, "documents").select("doc_id")
    return rows.select("doc_id", F.posexplode(V.sin_cos(F.col("doc_id"), 8)).alias("i", "v")).select("doc_id", "i", F.round("v", 6).alias("v"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(0, len(embedding)), lambda i: -(CASE WHEN i = label THEN ln(greatest(1 / (1 + exp(-embedding[i + 1]::DOUBLE)), 1e-8)) ELSE ln(greatest(least(1 - 1 / (1 + exp(-embedding[i + 1]::DOUBLE)) + 0.05, 1.0), 1e-8)) END)
 * pow(1 - CASE WHEN i = label THEN 1 / (1 + exp(-embedding[i + 1]::DOUBLE)) ELSE least(1 - 1 / (1 + exp(-embedding[i + 1]::DOUBLE)) + 0.05, 1.0) END, CASE WHEN i = label THEN 1.0 ELSE 4.0 END))), 5) + 0.0 AS loss FROM embeddings""")
def asymmetric_loss(spark, d):
    """Asymmetric multi-label loss over all classes of a vector."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("e"))
    each = F.transform("e", lambda x, i: V.asymmetric_loss(x, (i == F.col("label")).cast("int")))
    return rows.select("vec_id", (F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("loss"))


@query("SELECT label, CAST(i - 1 AS INT) AS i, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def mean_pool(spark, d):
    """Element-wise means of whole vectors."""
    e = table(spark, d, "embeddings").select("label", V.as_double(F.col("embedding")).alias("embedding"))
    return A.mean_pool(e, ["label"], "embedding").select("label", F.posexplode("embedding").alias("i", "m")).select("label", "i", (F.round("m", 5) + 0.0).alias("m"))


@query("SELECT a.vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 5) AS diff FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def channel_difference(spark, d):
    """Mean absolute difference of two channels."""
    e = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("e"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("other")), "vec_id")
    return j.select("vec_id", F.round(V.mean_difference(F.col("e"), F.col("other")), 5).alias("diff"))


# ---------------------------------------------------------------- labels

_VOCAB = "SELECT w AS label, CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS label_id FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) t"


@query(_VOCAB)
def vocabulary(spark, d):
    """Sorted distinct labels with their index."""
    return A.vocabulary(table(spark, d, "part").select(F.split("p_name", " ").alias("w")), "w")


@query("""SELECT p_partkey, list_transform(range(5), lambda i: CASE WHEN i = p_size % 5 OR i = p_partkey % 5 THEN 1 ELSE 0 END)::VARCHAR AS hot, CAST([p_size, p_size + 1][(p_partkey % 2) + 1] AS INT) AS picked FROM part""")
def multihot(spark, d):
    """Multi-hot vectors and picked elements."""
    p = table(spark, d, "part")
    ids = F.array((F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 5).cast("int"))
    hot = F.transform(V.multi_hot(ids, 5), lambda x: x.cast("int").cast("string"))
    return p.select("p_partkey", F.concat(F.lit("["), F.array_join(hot, ", "), F.lit("]")).alias("hot"), V.pick(F.array("p_size", F.col("p_size") + 1), F.array((F.col("p_partkey") % 2).cast("int")))[0].alias("picked"))


@query("SELECT p_partkey, p_type IN ('PROMO', 'SMALL') OR p_brand IN ('PROMO', 'SMALL') AS relevant FROM part")
def relevant_labels(spark, d):
    """Any label of a class list."""
    return table(spark, d, "part").select("p_partkey", A.relevant(F.array("p_type", "p_brand"), ["PROMO", "SMALL"]).alias("relevant"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '[0, 0]' ELSE '[' || (1 - l.quality) || ', ' || l.quality || ']' END AS labels FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_lookup(spark, d):
    """Key to label vector, zeros where there is none."""
    labels = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("int")).alias("ids"))
    out = L.label_vectors(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "ids", 2)
    return out.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), ", "), F.lit("]")).alias("labels"))


@query("SELECT p_partkey, p_type IN ('PROMO', 'SMALL') AS in_test, p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AS in_train FROM part")
def class_split_membership(spark, d):
    """Rows whose class is in a split."""
    splits = spark.createDataFrame([("PROMO", "test"), ("SMALL", "test"), ("ECONOMY", "train"), ("LARGE", "train"), ("MEDIUM", "train")], "name string, split string")
    p = table(spark, d, "part").select("p_partkey", F.array("p_type").alias("names"))
    return L.membership(p, "p_partkey", "names", splits).select("p_partkey", "in_test", "in_train")


@query("SELECT * FROM (VALUES (0, 'cat|dog'), (1, 'sun'), (2, '')) t(id, labels)")
def multilabel_parse(spark, d):
    """Label lists written as text."""
    rows = spark.createDataFrame([(0, "[cat, dog]"), (1, "[sun]"), (2, "[]")], "id int, s string")
    return rows.select("id", F.array_join(FS.label_list(F.col("s")), "|").alias("labels"))


# ---------------------------------------------------------------- tokens, sequences, conversations

@query("""SELECT conv_id, turn, array_to_string((list_concat(ids, [0, 0, 0, 0, 0, 0]))[1:6], ',') AS ids, array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') AS mask
FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations) t""")
def pad_truncate(spark, d):
    """Ids cut or filled to a length, with a mask."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("lengths"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return c.select("conv_id", "turn", join(V.padded(F.col("lengths"), 6)).alias("ids"), join(V.pad_mask(F.col("lengths"), 6)).alias("mask"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(list_transform(range(len(ids)), lambda i: CASE WHEN ids[i + 1] > 2 THEN ids[i + 1] END), lambda x: x IS NOT NULL)[3:], ',') AS kept
FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations) t""")
def masked_positions(spark, d):
    """Positions whose mask is set, a prefix dropped."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    kept = V.masked(F.col("ids"), F.transform("ids", lambda x: (x > 2).cast("int")), 2)
    return c.select("conv_id", "turn", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


def _items(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.when(F.col("role") == "user", "text").otherwise("image").alias("kind"), F.col("text").alias("value")).alias("x"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("items"))


@query("""SELECT conv_id, md5(arg_max(text, turn) FILTER (role <> 'user')) AS image, md5(arg_max(text, turn) FILTER (role = 'user')) AS text FROM conversations GROUP BY conv_id""")
def last_per_type(spark, d):
    """The last output of each type, as digests."""
    last = A.last_of_kind(F.col("items"))
    return _items(spark, d).select("conv_id", F.md5(last["image"]).alias("image"), F.md5(last["text"]).alias("text"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN '[t:' ELSE '[i:' END || text || ']' AS mark, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS lt FROM conversations)
SELECT conv_id, md5(string_agg(mark, '' ORDER BY turn)) AS context, md5(coalesce(string_agg(mark, '' ORDER BY turn) FILTER (turn < lt), '')) AS before_text FROM m GROUP BY conv_id""")
def fold_conversation(spark, d):
    """A left fold of mixed items, forked at the last text, as digests."""
    fold = _items(spark, d).select("conv_id", A.folded_context(F.col("items")).alias("f"))
    return fold.select("conv_id", F.md5("f.context").alias("context"), F.md5("f.before_text").alias("before_text"))


@query("""SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS INT) AS users, CAST(least(count(*) FILTER (role = 'user'), count(*) FILTER (role <> 'user')) AS INT) AS pairs FROM conversations GROUP BY conv_id""")
def positional_zip(spark, d):
    """Positional pairs, the shorter side wins."""
    i = _items(spark, d)
    users, others = F.filter("items", lambda x: x["kind"] == "text"), F.filter("items", lambda x: x["kind"] != "text")
    return i.select("conv_id", F.size(users).alias("users"), F.size(L.zip_shortest(users, others)).alias("pairs"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def upsert(spark, d):
    """New rows replace old ones by key (K5)."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return L.upsert(docs, docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id")


@query("SELECT regexp_extract(name, '^(.*)_in$', 1) AS stem, count(*) AS n FROM (SELECT p_type || '_' || p_size || '_in' AS name FROM part) t GROUP BY 1")
def in_out_pairs(spark, d):
    """Names paired by suffix swap (J7); see file_pairs for files."""
    p = table(spark, d, "part").select(F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("s"))
    names = p.select(F.concat("s", F.lit("_in")).alias("name")).unionByName(p.select(F.concat("s", F.lit("_out")).alias("name")).distinct())
    return L.paired_by_stem(names, "name").groupBy("stem").agg(F.count("*").alias("n"))


def _unit_sql(name: str, column: str, low: float, high: float) -> str:
    """DuckDB form of scorers.stand_in."""
    return f"({low} + ({high} - {low}) * (('0x' || substr(md5('{name}' || {column}), 1, 8))::BIGINT / 4294967296.0))"


@query(f"SELECT doc_id, round({_unit_sql('aesthetic', 'text', 1.0, 10.0)}, 6) AS aesthetic, doc_id % 97 = 0 AS failed FROM documents WHERE doc_id % 97 <> 0 UNION ALL SELECT doc_id, NULL, true FROM documents WHERE doc_id % 97 = 0")
def scorer_stand_in(spark, d):
    """A scorer over all rows behind the interface; rows that fail get nulls and their error."""
    base = C.STAND_INS["aesthetic"]

    def batch(model, frame):
        if (frame["doc_id"] % 97 == 0).any():
            raise ValueError("unreadable")
        return base.batch(model, frame)

    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("payload"))
    scored = C.apply_scorer(docs, C.Scorer("aesthetic", ("doc_id", "payload"), "aesthetic double", batch), tries=1, limit=60)
    return scored.select("doc_id", F.round("aesthetic", 6).alias("aesthetic"), F.col("aesthetic_error").isNotNull().alias("failed"))


@query(f"""SELECT doc_id, round({_unit_sql('aesthetic', 'text', 1.0, 10.0)}, 6) AS aesthetic, round({_unit_sql('liqe', 'text', 1.0, 5.0)}, 6) AS liqe, round({_unit_sql('clip_iqa', 'text', 0.0, 1.0)}, 6) AS clip_iqa FROM documents
WHERE {_unit_sql('aesthetic', 'text', 1.0, 10.0)} >= 4 AND {_unit_sql('liqe', 'text', 1.0, 5.0)} >= 3 AND {_unit_sql('clip_iqa', 'text', 0.0, 1.0)} >= 0.5""")
def scorer_chain(spark, d):
    """Three scorers, each behind the gate of the one before."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("payload"))
    stages = [(C.STAND_INS["aesthetic"], "aesthetic >= 4"), (C.STAND_INS["liqe"], "liqe >= 3"), (C.STAND_INS["clip_iqa"], "clip_iqa >= 0.5")]
    return C.chained(docs, stages).select("doc_id", *[F.round(c, 6).alias(c) for c in ("aesthetic", "liqe", "clip_iqa")])


@query("SELECT doc_id, lang || chr(10) || source || chr(10) || '1, 2' AS audit FROM documents")
def audit_column(spark, d):
    """The audit text of a sample."""
    from loomspark.operators.sinks import audit_text

    return table(spark, d, "documents").select("doc_id", audit_text(F.col("lang"), F.col("source"), F.array(F.lit(1), F.lit(2))).alias("audit"))


# ---------------------------------------------------------------- events (extension: windows)

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Hourly counts by kind, as a stream does with a watermark (extension)."""
    from loomspark.streaming.scores import event_windows

    return event_windows(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    """Sessions by a gap of half an hour (extension)."""
    from loomspark.streaming.scores import sessions

    return sessions(table(spark, d, "events")).select("user_id", "start", "n")


# ---------------------------------------------------------------- requests, keys, losses

_KEY_BYTES = b"not a secret"
_PAD = lambda pad: "".join(f"\\x{b ^ pad:02X}" for b in _KEY_BYTES.ljust(64, b"\0"))


@query(f"""SELECT p_partkey, q AS query, sha256('{_PAD(0x5C)}'::BLOB || unhex(sha256('{_PAD(0x36)}'::BLOB || encode(q)))) AS signature
FROM (SELECT p_partkey, 'brand=' || replace(p_brand, '#', '%23') || '&size=' || p_size || '&type=' || p_type AS q FROM part) t""")
def signed_requests(spark, d):
    """Parameters in order of their names with a keyed hash."""
    params = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), "p_brand")
    return table(spark, d, "part").select("p_partkey", X.signed_request(_KEY_BYTES, params).alias("x")).select("p_partkey", "x.query", "x.signature")


@query("SELECT n_name, coalesce(lead(n_name) OVER (ORDER BY n_nationkey), (SELECT n_name FROM nation WHERE n_nationkey = 0)) AS next FROM nation")
def key_ring(spark, d):
    """The next key in the ring."""
    return L.next_in_ring(table(spark, d, "nation"), "n_name", "n_nationkey")


@query("SELECT p_partkey, CAST(p_size AS INT) AS layer FROM part WHERE p_size IN (3, 7, 19)")
def layer_parameters(spark, d):
    """Parameter names matched with the layers that are trained."""
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("blocks."), F.col("p_size").cast("string"), F.lit(".attn.w"), F.col("p_partkey").cast("string")).alias("name"))
    layers = spark.createDataFrame([(3,), (7,), (19,)], "layer int")
    return L.layer_matches(names, "name", layers, "layer").select("p_partkey", "layer")


@query("""SELECT CAST(step // 4 AS BIGINT) AS update, round(sum(m) / 4, 6) AS loss FROM (SELECT o_orderkey // 8 AS step, avg(ln(o_totalprice)) AS m FROM orders GROUP BY 1) t GROUP BY 1""")
def accumulated_loss(spark, d):
    """Mean loss over processes and accumulated steps."""
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("step"), (F.col("o_orderkey") % 8).alias("process"), F.log("o_totalprice").alias("loss"))
    return A.accumulated_loss(o, "step", "process", "loss", 4).select("update", F.round("loss", 6).alias("loss"))


@query("SELECT lang, count(*) AS picked FROM documents WHERE n_chars > 500 GROUP BY lang")
def selected_counts(spark, d):
    """How many rows a selection keeps."""
    return table(spark, d, "documents").where("n_chars > 500").groupBy("lang").agg(F.count("*").alias("picked"))
