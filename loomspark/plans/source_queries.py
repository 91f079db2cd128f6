"""Queries that write the driver's tables as the files that producers leave, and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import regions as RE
from loomspark.operators import rules as R
from loomspark.operators import sampling as S
from loomspark.operators import sinks as K
from loomspark.plans.catalog import query
from loomspark.session import put, scratch, table
from loomspark.sources import files as FS
from loomspark.sources import members as ME
from loomspark.sources import paths, shards
from loomspark.streaming import scores as ST

# ---------------------------------------------------------------- edit records

# Fixed values of the queries below: labels and tasks that records take in turn.
_LABELS = ["grit-entity-new", "AnyEdit", "Delete", "step1x", "gpt4o", "kontext", "Subjects200K", "Style Transfer", "OmniConsistency"]
_TASKS = ["文字更改", "人物修图", "删除主体", "text change"]
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

#: Fields of a record as columns, from a document's number and names; null fields are left out of its JSON.
_RECORDS = f"""SELECT doc_id, {_LIST(_LABELS)}[doc_id % 9 + 1] AS label, {_LIST(_TASKS)}[doc_id // 2 % 4 + 1] AS task,
CASE WHEN doc_id % 5 = 0 THEN '改成蓝色' WHEN doc_id % 13 <> 1 THEN lang || ' ' || source END AS instruction, 'zh ' || source AS instruction_zh, 'style ' || lang AS style_zh,
CASE WHEN doc_id % 7 <> 0 THEN [doc_id % 11, doc_id // 10 % 11] END AS score, CASE WHEN doc_id % 2 = 0 THEN [doc_id // 3 % 7, doc_id // 5 % 7] END AS score_7b,
doc_id % 50 / 10.0 AS liqe_score_edit, doc_id % 70 / 10.0 AS aesthetic_score_v2_5_edit, doc_id % 10 / 10.0 AS liqe_score_clip_edit, CASE WHEN doc_id % 4 <> 3 THEN doc_id % 80 / 10.0 END AS aesthetic_score,
CASE WHEN doc_id % 12 = 1 THEN NULL WHEN doc_id % 11 = 0 THEN [''] WHEN doc_id % 17 = 0 THEN [] ELSE [source, lang] END AS caption_en,
CASE WHEN doc_id % 3 = 0 THEN source END AS caption_en_ori, CASE WHEN doc_id % 4 = 0 THEN 'fine ' || lang END AS label_fine FROM documents"""


def _metadata(spark, d):
    """doc_id and the record as one JSON text: scores as text or as lists, numbers alone or in a list, one caption as text."""
    n = F.col("doc_id")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    string = lambda name, c: F.concat(F.lit(f'"{name}": '), F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    raw = lambda name, c: F.concat(F.lit(f'"{name}": '), c)
    score = listed(F.array((n % 11).cast("string"), (F.floor(n / 10) % 11).cast("string")))
    tenth = lambda m: (n % m / 10.0).cast("string")
    fields = [
        string("label", pick(_LABELS, n % 9)),
        string("task", pick(_TASKS, F.floor(n / 2) % 4)),
        F.when(n % 5 == 0, string("instruction", F.lit("改成蓝色"))).when(n % 13 != 1, string("instruction", F.concat_ws(" ", "lang", "source"))),
        string("instruction_zh", F.concat(F.lit("zh "), "source")),
        string("style_zh", F.concat(F.lit("style "), "lang")),
        F.when(n % 7 == 1, raw("score", score)).when(n % 7 != 0, string("score", score)),
        F.when(n % 2 == 0, raw("score_7b", listed(F.array((F.floor(n / 3) % 7).cast("string"), (F.floor(n / 5) % 7).cast("string"))))),
        F.when(n % 3 == 0, raw("liqe_score_edit", listed(F.array(tenth(50))))).otherwise(raw("liqe_score_edit", tenth(50))),
        raw("aesthetic_score_v2_5_edit", tenth(70)),
        raw("liqe_score_clip_edit", tenth(10)),
        F.when(n % 4 != 3, raw("aesthetic_score", tenth(80))),
        F.when(n % 12 == 1, None).when(n % 11 == 0, string("caption_en", F.lit(""))).when(n % 17 == 0, F.lit('"caption_en": []')).otherwise(raw("caption_en", F.to_json(F.array("source", "lang")))),
        F.when(n % 3 == 0, string("caption_en_ori", F.col("source"))),
        F.when(n % 4 == 0, string("label_fine", F.concat(F.lit("fine "), "lang"))),
    ]
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("raw"))


def _rejected_sql(latin: bool, aesthetic: bool) -> str:
    latin_rule = " OR coalesce(task = '文字更改' AND NOT regexp_matches(instruction, '[a-zA-Z]'), false)" if latin else ""
    aesthetic_rule = " OR coalesce(score_7b IS NULL AND aesthetic_score < 6, false)" if aesthetic else ""
    step = "coalesce((score_7b IS NOT NULL AND (liqe_score_edit < 3 OR aesthetic_score_v2_5_edit < 4.8 OR liqe_score_clip_edit < 0.6 OR list_sum(score_7b) < 9)) OR (score_7b IS NULL AND list_sum(score) < 18), false)"
    gpt = "coalesce(score_7b IS NOT NULL AND task IN ('动作更改', '人物修图', '文字更改'), false)"
    return f"""(coalesce(CASE label WHEN 'grit-entity-new' THEN caption_en_ori IS NULL AND caption_en IS NULL WHEN 'AnyEdit' THEN label_fine IS NULL WHEN 'Delete' THEN list_sum(score) < 9
WHEN 'step1x' THEN {step}{latin_rule} WHEN 'gpt4o' THEN {gpt}{aesthetic_rule} END, false) OR coalesce(len(caption_en) = 0 OR caption_en = [''], false))"""


@query(f"SELECT doc_id, {_rejected_sql(True, True)} AS r1024, {_rejected_sql(True, False)} AS r512, {_rejected_sql(False, False)} AS rqwen FROM ({_RECORDS}) t")
def edit_admission(spark, d):
    """Metadata documents parsed and judged by the admission rules of the training variants."""
    rows = _metadata(spark, d).select("doc_id", R.read_metadata(F.col("raw")).alias("m"))
    return rows.select("doc_id", R.rejected(F.col("m"), R.VARIANTS["1024"]).alias("r1024"), R.rejected(F.col("m"), R.VARIANTS["512"]).alias("r512"), R.rejected(F.col("m"), R.VARIANTS["qwen_512"]).alias("rqwen"))


_DRAW = "('0x' || substr(md5('p' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT"
_FLIP = f"(({_DRAW} + 1) / 4294967297.0 < 0.5)"


@query(f"""SELECT doc_id,
CASE WHEN label = 'Subjects200K' AND doc_id % 2 = 0 THEN CASE WHEN {_FLIP} THEN 'Canny image generates images' ELSE 'Depth image generates images' END WHEN label IN ('Subjects200K', 'AnyEdit') THEN caption_en[1]
 WHEN label = 'Style Transfer' THEN style_zh WHEN label = 'Delete' THEN instruction_zh WHEN label = 'OmniConsistency' THEN instruction
 WHEN instruction IS NULL AND caption_en IS NOT NULL THEN CASE WHEN len(caption_en) > 0 THEN caption_en[{_DRAW} % len(caption_en) + 1] END ELSE instruction END AS instruction,
CASE WHEN label = 'Subjects200K' AND doc_id % 2 = 0 THEN CASE WHEN {_FLIP} THEN '1.1.jpg' ELSE '1.2.jpg' END WHEN label = 'Style Transfer' THEN 'jpg' ELSE '1.0.jpg' END AS source, CASE WHEN label = 'Style Transfer' THEN 'png' ELSE '2.jpg' END AS target,
CASE WHEN label = 'Subjects200K' AND doc_id % 2 = 0 THEN 'low_leval' WHEN label = 'Subjects200K' THEN 'subject' WHEN label = 'AnyEdit' THEN label_fine WHEN label = 'Style Transfer' THEN 'style' WHEN label = 'Delete' THEN 'removal'
 WHEN label = 'OmniConsistency' THEN CASE WHEN task = 'text change' THEN task ELSE 'style' END WHEN instruction IS NULL AND caption_en IS NOT NULL THEN label ELSE task END AS edit_type FROM ({_RECORDS}) t""")
def edit_projection(spark, d):
    """Metadata documents projected by label to instruction, source, target and edit type."""
    rows = _metadata(spark, d).select("doc_id", R.read_metadata(F.col("raw")).alias("m"))
    return rows.select("doc_id", R.projected(F.col("m"), F.col("doc_id"), F.col("doc_id") % 2 == 0, "p").alias("x")).select("doc_id", "x.*")


# ---------------------------------------------------------------- text files


@query("SELECT trim(l) AS prompt, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) t WHERE trim(l) <> '' AND NOT contains(trim(l), 'that') GROUP BY 1")
def prompt_files(spark, d):
    """Prompt lists written and read again, lines with a word left out."""
    root = scratch(spark)
    table(spark, d, "conversations").select("text").write.text(root)
    return FS.prompts(spark, root, without="that").groupBy("prompt").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS lines FROM documents")
def inline_words(spark, d):
    """Non-blank lines of a multi-line text."""
    return table(spark, d, "documents").select("doc_id", F.size(FS.words_of(F.col("text"))).alias("lines"))


@query("""WITH s AS (SELECT source || ' ' || CAST(doc_id % 50 AS VARCHAR) AS instruction, avg(quality) AS q, avg(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT instruction, round(q, 4) AS q, round(t, 4) AS t FROM s""")
def score_log_files(spark, d):
    """Score lines appended in two goes, a trailer beside them, and the log read back."""
    root = scratch(spark)
    scored = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    scored = scored.withColumn("instruction", F.concat("source", F.lit(" "), (F.col("doc_id") % 50).cast("string")))
    scored = scored.select("doc_id", "instruction", F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("score"))
    for half in (0, 1):
        K.write_scores(scored.where(F.col("doc_id") % 2 == half), f"{root}/log")
    put(spark, f"{root}/log/trailer.txt", b"final score: [1.0, 2.0, 3.0]\nbroken line\n")
    K.write_summary(scored.groupBy().agg(F.count("*").alias("n")), f"{root}/summary")
    log = FS.score_log(spark, f"{root}/log")
    return log.groupBy("instruction").agg(F.round(F.avg(F.col("score")[0]), 4).alias("q"), F.round(F.avg(F.col("score")[1]), 4).alias("t"))


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents")
def json_rows(spark, d):
    """JSON lines written and read with a schema."""
    root = scratch(spark)
    table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars").write.json(root)
    rows = FS.json_lines(spark, root, "doc_id long, text string, lang string, n_chars long")
    return rows.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query("SELECT p_partkey || '.jpg' AS path, p_type || '|' || p_brand AS labels, CASE WHEN p_partkey % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM part")
def csv_files(spark, d):
    """Multi-label tables of three and of two columns."""
    root = scratch(spark)
    p = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.concat(F.lit("["), "p_type", F.lit(", "), "p_brand", F.lit("]")).alias("labels"), (F.col("p_partkey") % 3 == 0).alias("val"))
    p.where("val").select("path", "labels", F.lit("val").alias("split")).write.csv(f"{root}/three", quoteAll=True)
    p.where("NOT val").select("path", "labels").write.csv(f"{root}/two", quoteAll=True)
    read = FS.multi_label_csv(spark, f"{root}/three").unionByName(FS.multi_label_csv(spark, f"{root}/two"))
    return read.select("path", F.array_join("labels", "|").alias("labels"), "split")


@query("SELECT p_type AS key, CAST(p_size AS INT) AS label_id FROM part GROUP BY 1, 2")
def label_files(spark, d):
    """A label dictionary as one JSON object, read to rows."""
    ids = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set(F.col("p_size").cast("int"))).alias("ids"))  # one row a type
    root = scratch(spark)
    ids.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "ids")))).alias("value")).write.text(root)
    return FS.label_dictionary(spark, root).select("key", F.explode("label_ids").alias("label_id"))


@query("SELECT r_name AS name, 'Show <thing> in ' || r_name AS text, 'Show a dog in ' || r_name AS filled FROM region")
def template_files(spark, d):
    """Prompt templates of a folder, by file name, and filled."""
    root = scratch(spark)
    for (name,) in table(spark, d, "region").select("r_name").collect():  # five rows
        put(spark, f"{root}/{name}.txt", f"Show <thing> in {name}".encode())
    rows = FS.templates(spark, root)
    return rows.select(F.regexp_replace("name", "%20", " ").alias("name"), "text", X.fill_template(F.col("text"), thing=F.lit("a dog")).alias("filled"))


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS text FROM nation")
def joined_prompts(spark, d):
    """Prompt files put together in order."""
    return FS.concatenated(table(spark, d, "nation"), "n_nationkey", "n_name")


# ---------------------------------------------------------------- folders and shards


@query("SELECT r_name AS folder, n_name AS instruction FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def file_pairs(spark, d):
    """In and out files of task folders; sources without an edited file stay out."""
    root = scratch(spark)
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # 25 rows
    for number, name, region in names:
        put(spark, f"{root}/{region}/{name}_in.jpg", b"x")
        if number % 3:
            put(spark, f"{root}/{region}/{name}_out.jpg", b"y")
    pairs = FS.edit_pairs(FS.files(spark, root, "*.jpg"))
    plain = lambda c: F.replace(F.col(c), F.lit("%20"), F.lit(" "))
    return pairs.select(plain("folder").alias("folder"), plain("instruction").alias("instruction"))


def _shards(spark, d) -> str:
    """Pages as shards of at most 20 samples, each with its html and a JSON record, written by the shard writer."""
    root = scratch(spark)
    p = table(spark, d, "pages").withColumn("key", F.lpad(F.col("page_id").cast("string"), 9, "0"))
    html = p.select("key", F.lit("html").alias("ext"), F.col("html").cast("binary").alias("payload"))
    meta = p.select("key", F.lit("json").alias("ext"), F.to_json(F.struct("page_id", "url")).cast("binary").alias("payload"))
    image = p.select("key", F.when(F.col("page_id") % 2 == 0, "1.0.jpg").otherwise("1.jpg").alias("ext"), F.concat(F.lit("img"), "key").cast("binary").alias("payload"))
    shards.write_shards(html.unionByName(meta).unionByName(image), root, maxcount=20)
    return root


@query("SELECT page_id, url, md5(html) AS digest, 'img' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS image FROM pages")
def shard_round_trip(spark, d):
    """Rolling tar shards written, listed by pattern, read and grouped to samples, keys of images normalised."""
    root = _shards(spark, d)
    members = shards.read_members(spark, paths.listed(spark, f"{root}/*"))
    names = ["html", "json", "1.0.jpg", "1.jpg"]
    m = F.col("m")
    record = F.from_json(m["json"].cast("string"), "page_id long, url string")
    return shards.samples(members, names).select(record["page_id"].alias("page_id"), record["url"].alias("url"), F.md5(m["html"]).alias("digest"), shards.image_keys(m, names).cast("string").alias("image"))


@query("SELECT CAST(count(*) AS BIGINT) * 3 AS members, true AS within, CAST(1 AS BIGINT) AS bad FROM pages")
def shard_health(spark, d):
    """Shards checked, a broken one set apart without stopping the rest (S6, F29), no shard over its size (K1)."""
    root = _shards(spark, d)
    put(spark, f"{root}/broken.tar", b"no tar at all" * 100)
    checked = shards.health(shards.read_members(spark, paths.listed(spark, f"{root}/*.tar")))
    return checked.agg(F.sum("members").alias("members"), (F.max("members") <= 60).alias("within"), F.sum(F.col("error").isNotNull().cast("long")).alias("bad"))


@query("SELECT lpad(CAST(page_id AS VARCHAR), 9, '0') AS key, md5(html) AS digest, CAST(1 AS BIGINT) AS copies FROM pages")
def shard_appends(spark, d):
    """Shards written by three commits, one of them twice: all members are there, each once (K1)."""
    root = scratch(spark)
    p = table(spark, d, "pages").select("page_id", F.lpad(F.col("page_id").cast("string"), 9, "0").alias("key"), F.lit("html").alias("ext"), F.col("html").cast("binary").alias("payload"))
    for part in (0, 1, 1, 2):  # the second batch runs again, as after a crash
        shards.write_shards(p.where(F.col("page_id") % 3 == part).drop("page_id"), root, maxcount=100, writer="pages", batch=part)
    members = shards.read_members(spark, paths.listed(spark, f"{root}/*.tar"))
    return members.groupBy("key").agg(F.max(F.md5("payload")).alias("digest"), F.count("*").alias("copies"))


@query("SELECT lpad(CAST(page_id AS VARCHAR), 9, '0') AS key, md5(html) AS digest FROM pages WHERE page_id % 9 = 4")
def member_lookup(spark, d):
    """Members fetched by key: their places come from the index beside the shards, and only their bytes are read."""
    root = _shards(spark, d)
    by_key = scratch(spark)
    ME.write_by_key(ME.written_index(spark, root), by_key, buckets=8)
    wanted = table(spark, d, "pages").where("page_id % 9 = 4").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("key"))
    found = ME.fetched(ME.by_key(spark, by_key, wanted, buckets=8).where("ext = 'html'"))
    return found.select("key", F.md5("payload").alias("digest"))


@query("SELECT lpad(CAST(page_id AS VARCHAR), 9, '0') AS key, md5(html) AS digest FROM pages WHERE page_id % 4 <> 1")
def member_cache(spark, d):
    """Members of any shards, indexed by their headers, through a cache that three lookups fill."""
    root, cache, index = _shards(spark, d), scratch(spark), scratch(spark)
    ME.indexed(spark, paths.listed(spark, f"{root}/*.tar")).where("ext = 'html'").write.parquet(index)  # each lookup reads it more than once
    places = spark.read.parquet(index)
    for kept in ("% 4 = 0", "% 2 = 0", "% 4 <> 1"):
        found = ME.cached(spark, places.where(f"cast(key AS long) {kept}"), cache, buckets=8)
    return found.select("key", F.md5("payload").alias("digest"))


@query("SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM pages")
def listed_paths(spark, d):
    """Roots by braces and lists with separators, listed one after the other, repeats kept."""
    root = scratch(spark)
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("key"), F.lit("url").alias("ext"), F.col("url").cast("binary").alias("payload"))
    for i, name in enumerate(("even", "odd")):
        shards.write_shards(p.where(F.col("page_id") % 2 == i).drop("page_id"), f"{root}/{name}", maxcount=50)
    members = shards.read_members(spark, paths.listed(spark, f"{root}/{{even,odd}}/*.tar::{root}/even/*.tar"))
    return members.groupBy(F.col("key").cast("long").alias("page_id")).agg(F.count("*").alias("copies"))


# ---------------------------------------------------------------- tables


@query("SELECT count(*) AS n, true AS within, count(DISTINCT lang) AS parts FROM documents")
def rolling_files(spark, d):
    """Tables in files of at most 300 rows, a folder a language (K1, K2)."""
    root = scratch(spark)
    K.write_rolling(table(spark, d, "documents").select("doc_id", "lang"), root, rows=300, part="lang")
    per = spark.read.parquet(root).groupBy(F.input_file_name().alias("file"), "lang").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 300).alias("within"), F.countDistinct("lang").alias("parts"))


@query("SELECT CASE WHEN ((('0x' || substr(md5('s' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT + 1) / 4294967297.0) < 0.9 THEN 'train' ELSE 'val' END AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def manifest_files(spark, d):
    """Split manifests written and read by part."""
    root = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", S.split_by_hash("s", F.col("doc_id"), {"train": 0.9, "val": 0.1}).alias("part"))
    K.write_manifest(docs, root, "doc_id", "part")
    return spark.read.parquet(root).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, CASE WHEN n_chars > 2000 OR lang = 'fr' THEN 'long: ' || source END AS error FROM documents")
def quarantine(spark, d):
    """Bad rows set apart with a reason (K6)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    good, bad = K.quarantined(docs, F.when(F.col("lang") == "fr", None).otherwise(F.col("n_chars") > 2000), F.concat(F.lit("long: "), "source"))
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", F.col("_error").alias("error")))


@query("""SELECT draw, doc_id FROM (SELECT unnest(range(500, 500 + 2 * (SELECT count(*) FROM documents))) AS draw) t
JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents) k ON k.number = ('0x' || substr(md5('5/' || draw), 1, 15))::BIGINT % (SELECT count(*) FROM documents)""")
def resampled_rows(spark, d):
    """Draws with replacement by number, those that the endless source gives from number 500 on."""
    docs = table(spark, d, "documents").select("doc_id")
    return ST.resampled_batch(spark, docs, "doc_id", 2 * docs.count(), seed="5", first=500)


@query("SELECT doc_id FROM documents")
def shuffle_buffer(spark, d):
    """Rows mixed within their partitions as they pass, none lost (M6)."""
    return S.shuffle_buffer(table(spark, d, "documents").select("doc_id"), "b", 100)


def _spread_parts(spark, d):
    """Keys of the parts over all tasks: their file is so small that Spark would read it in a few."""
    return table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


@query("""WITH RECURSIVE cells AS (
    SELECT p_partkey AS k, i // 8 AS r, i % 8 AS c FROM part, range(64) t(i) WHERE substr(md5('x' || p_partkey) || md5('y' || p_partkey), CAST(i + 1 AS INT), 1) < '5'
), reach AS (
    SELECT k, r AS r0, c AS c0, r, c FROM cells
    UNION SELECT a.k, a.r0, a.c0, b.r, b.c FROM reach a JOIN cells b ON a.k = b.k AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
), labelled AS (SELECT k, r, c, min(r0 * 8 + c0) AS region FROM reach GROUP BY k, r, c),
boxes AS (SELECT k, region, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM labelled GROUP BY k, region)
SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY y, x, h, w, area) - 1 AS INT) AS label, area, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM boxes WHERE w * h >= 4""")
def mask_regions(spark, d):
    """Connected regions of run-length-coded masks with their boxes, the small ones left out."""
    hashed = lambda salt: F.md5(F.concat(F.lit(salt), F.col("p_partkey").cast("string")))
    bits = F.transform(F.split(F.concat(hashed("x"), hashed("y")), ""), lambda c: (c < "5").cast("int"))
    masks = _spread_parts(spark, d).select("p_partkey", RE.run_lengths(bits).alias("runs"), F.lit(8).alias("width"))
    found = RE.mask_regions(masks, "runs", "width", least=4, fields=["label", "area", "x", "y", "w", "h"]).select("p_partkey", F.inline("regions"))
    return found.select("p_partkey", "label", "area", "x", "y", "w", "h")


@query("""SELECT p_partkey, CAST(count(*) FILTER (a) AS BIGINT) AS area, CAST(count(*) FILTER (b) AS BIGINT) AS grown FROM (
    SELECT p.p_partkey, i, substr(md5('x' || p.p_partkey), CAST(i + 1 AS INT), 1) < '3' AS a,
        EXISTS (SELECT 1 FROM range(32) u(j) WHERE abs(j // 8 - i // 8) <= 2 AND abs(j % 8 - i % 8) <= 2 AND substr(md5('x' || p.p_partkey), CAST(j + 1 AS INT), 1) < '3') AS b
    FROM part p, range(32) t(i)) GROUP BY p_partkey""")
def mask_dilation(spark, d):
    """Areas of masks and of the same masks grown by two pixels."""
    digest = F.md5(F.concat(F.lit("x"), F.col("p_partkey").cast("string")))
    bits = F.transform(F.split(digest, ""), lambda c: (c < "3").cast("int"))
    masks = _spread_parts(spark, d).select("p_partkey", RE.run_lengths(bits).alias("runs"), F.lit(8).alias("width"))
    grown = RE.dilated_masks(masks, "runs", "width", 2, "grown")
    return grown.select("p_partkey", RE.run_area(F.col("runs")).alias("area"), RE.run_area(F.col("grown")).alias("grown"))


@query("""SELECT l_orderkey, list_transform(range(3), lambda b: list_transform(range(7), lambda c: CASE WHEN len(list_filter(o, lambda x: x.c = c AND CASE WHEN x.a < 1024 THEN 0 WHEN x.a < 9216 THEN 1 ELSE 2 END = b)) > 0 THEN 1 ELSE 0 END))::VARCHAR AS hot
FROM (SELECT l_orderkey, list({'c': l_linenumber % 7, 'a': l_quantity * 250}) AS o FROM lineitem GROUP BY l_orderkey) t""")
def annotation_vectors(spark, d):
    """Objects of an image to three multi-hot vectors by size."""
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_linenumber") % 7).cast("int").alias("category"), (F.col("l_quantity") * 250).alias("area"))).alias("o"))
    text = lambda v: F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ", "), F.lit("]"))
    hot = F.transform(FS.annotations(F.col("o"), 7), text)
    return r.select("l_orderkey", F.concat(F.lit("["), F.array_join(hot, ", "), F.lit("]")).alias("hot"))


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 <> 0) AS whole, sum(p_size + 1)::BIGINT AS w FROM part")
def image_checks(spark, d):
    """Sizes from headers, and images cut short told apart (F1)."""
    import zlib

    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    def png(w: int) -> bytes:
        head = w.to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\x08\0\0\0\0"
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(w + 1))) + chunk(b"IEND", b"")

    made = spark.createDataFrame([(w, bytearray(png(w + 1))) for w in range(101)], "w int, payload binary")
    p = table(spark, d, "part").select("p_partkey", "p_size").join(F.broadcast(made), F.col("p_size") == F.col("w"))  # a hundred images
    cut = F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(payload, 1, length(payload) - 14)")).otherwise(F.col("payload"))
    found = p.select(FS.image_size(cut).alias("s"), FS.image_whole(cut).alias("whole"))
    return found.agg(F.count("*").alias("n"), F.sum(F.col("whole").cast("long")).alias("whole"), F.sum(F.col("s.w").cast("long")).alias("w"))


# ---------------------------------------------------------------- tokens


@query()
def token_counts(spark, d):
    """Token ids of whole messages by byte-pair encoding (X39); checked against a public tokenizer library."""
    import public_tokenizers

    from loomspark.functions.bpe import token_ids

    ids = token_ids(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


@query("SELECT conv_id, turn, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM conversations")
def token_round_trip(spark, d):
    """Token ids put back to the bytes they stand for."""
    import public_tokenizers

    from loomspark.functions.bpe import text_of, token_ids

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = table(spark, d, "conversations").select("conv_id", "turn", text_of(token_ids(F.col("text"), path), path).alias("bytes"))
    return rows.select("conv_id", "turn", F.octet_length("bytes").cast("long").alias("bytes"), F.md5("bytes").alias("digest"))
