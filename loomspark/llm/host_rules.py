"""Quality rules by host: failures of each rule are aggregated by host, shrunk and joined back, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import written

#: White space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words in a window that is looked for again in the same text.
WINDOW = 3
#: The base rules: fewest words, and the share of words in repeated windows (percent).
MIN_WORDS = 50
MAX_REPEATED = 50
#: Rules that count against a host only: symbols by word characters, and lines that repeat by lines with a word (percent).
MAX_SYMBOLS = 10
MAX_DUP_LINES = 30
#: A host goes whose shrunk rate of one of the rules is this high.
HOST_LIMIT = 0.8
#: Weight of the prior in documents where the hosts can't tell it (a single host, or no failures), and its bounds elsewhere.
STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 20.0, 1.0, 10000.0
#: The text's measures, in their order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """Adds MEASURES and n_lines (lines with a word), all long, for a text column without nulls.

    A text whose windows all differ by hash has no repeated one. In any other, one number a window (33 bits of its hash,
    then its position) is sorted, and windows whose bits come again are sorted once more by their words, so that a
    collision adds nothing. Both sorts are within the row.
    """
    size, none = F.size("__w"), F.array().cast("array<bigint>")
    behind = lambda name: F.slice(name, 2, F.size(name))
    df = docs.withColumn("__w", F.array_remove(F.split(text, SPACE), ""))
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    hashed = F.transform(F.slice("__h", 1, size - window + 1), lambda x, i: F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, window)]))
    df = df.withColumn("__h", F.when(size >= window, hashed).otherwise(none))
    keys = F.sort_array(F.transform("__h", lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))
    df = df.withColumn("__keys", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), keys).otherwise(none))
    alike = F.zip_with("__keys", behind("__keys"), lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), 31) == 0, F.array(x, y)))
    df = df.withColumn("__again", F.transform(F.array_distinct(F.flatten(F.array_compact(alike))), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
    said = lambda i: F.concat_ws(" ", *[F.get("__w", i + k) for k in range(window)])
    df = df.withColumn("__said", F.array_sort(F.transform("__again", lambda i: F.struct(said(i).alias("w"), i.alias("i")))))
    same = F.zip_with("__said", behind("__said"), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
    df = df.withColumn("__starts", F.sort_array(F.array_distinct(F.flatten(F.array_compact(same)))))
    covered = F.transform("__starts", lambda p, i: F.coalesce(F.least(F.lit(window), p - F.get("__starts", i - 1)), F.lit(window)).cast("long"))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def rules() -> dict[str, Column]:
    """What fails each rule, by a text's measures."""
    return {
        "words": F.col("n_words") < MIN_WORDS,
        "repeated": 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
    }


def host_verdicts(rows: DataFrame, host: str, failures: dict[str, Column], limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host (null is one): host, n, the shrunk rate of each rule (rate_<rule>) and host_failed.

    The prior of a rule is a beta distribution fitted to the hosts' counts by moments: its mean is the rate over all
    rows, its strength a+b follows from how much more hosts differ than chance lets them. A host's rate is the mean of
    its posterior, so that a few failures don't condemn a small host. Rows of a frequent host are folded before they
    are shuffled.
    """
    counts = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"f_{r}") for r, c in failures.items()]
    hosts = written(rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *counts))
    n, rate, chance = F.col("__n"), {r: F.col(f"__f_{r}") / F.col("__n") for r in failures}, (F.col("__hosts") - 1) / F.col("__n")
    sums = hosts.agg(
        F.count("*").alias("__hosts"), F.sum("n").alias("__n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("__nn"),
        *[x for r in failures for x in (F.sum(f"f_{r}").alias(f"__f_{r}"), F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"__q_{r}"))],
    )

    def strength(r: str) -> Column:
        room = rate[r] * (1 - rate[r])
        alike = (F.col(f"__q_{r}") / n - rate[r] * rate[r]) / room - chance
        apart = 1 - F.col("__nn") / (n * n) - chance
        found = F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), apart / alike - 1))
        return F.when((room <= 0) | (apart <= 0), STRENGTH).when(alike <= 0, MOST_STRENGTH).otherwise(found)

    prior = sums.select(*[x for r in failures for x in (rate[r].alias(f"__m_{r}"), strength(r).alias(f"__s_{r}"))])
    shrunk = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    shrunk = shrunk.select("host", "n", *[((F.col(f"__m_{r}") * F.col(f"__s_{r}") + F.col(f"f_{r}")) / (F.col(f"__s_{r}") + F.col("n"))).alias(f"rate_{r}") for r in failures])
    return shrunk.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in failures], F.lit(0.0)) >= limit)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, MEASURES (long), base_failed, host_failed, kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEATED percent of them in windows that come again. kept:
    neither the row nor its host failed. Null texts count as empty and null hosts as one host. Repeated rows come out
    as often and count as often in their host. Other columns are ignored, whatever their names; an empty table gives
    no rows. Texts stay whole, in the row: what is shuffled are measures.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = written(measured(rows, "__text").drop("__text"))
    failures = rules()
    verdicts = host_verdicts(rows, "__host", failures).select("host", "host_failed")
    joined = rows.join(verdicts, rows["__host"].eqNullSafe(verdicts["host"]), "left")
    base = failures["words"] | failures["repeated"]
    return joined.select(
        F.col("__id").alias(id_col), *MEASURES, base.alias("base_failed"), F.coalesce("host_failed", F.lit(False)).alias("host_failed"), (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )


def op13_host_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_failed")


ORACLE_SQL = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM texts
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= {WINDOW})
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM again, range(0, {WINDOW}) t(k)) GROUP BY r
), measured AS (
    SELECT split.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM split LEFT JOIN repeated USING (r)
), failed AS (
    SELECT r, source, rule, CAST(bad AS INT) AS bad FROM measured,
           LATERAL (VALUES ('words', n_words < {MIN_WORDS}), ('repeated', 100 * n_repeat_words > {MAX_REPEATED} * n_words),
                           ('symbols', 100 * n_symbols > {MAX_SYMBOLS} * word_chars), ('lines', 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines)) v(rule, bad)
), hosts AS (
    SELECT source, rule, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS f FROM failed GROUP BY ALL
), sums AS (
    SELECT rule, count(*) AS h, sum(n) AS nn, sum(n * n) AS squares, sum(f) / sum(n) AS m, sum(f * f / n) AS q FROM hosts GROUP BY rule
), moments AS (
    SELECT rule, m, m * (1 - m) AS room, 1 - squares / (nn * nn) - (h - 1) / nn AS apart,
           (q / nn - m * m) / nullif(m * (1 - m), 0) - (h - 1) / nn AS alike FROM sums
), prior AS (
    SELECT rule, m, CASE WHEN room <= 0 OR apart <= 0 THEN {STRENGTH} WHEN alike <= 0 THEN {MOST_STRENGTH}
                         ELSE greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, apart / alike - 1)) END AS s FROM moments
), verdicts AS (
    SELECT source, max((m * s + f) / (s + n)) >= {HOST_LIMIT} AS host_failed FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND NOT host_failed AS kept
FROM measured JOIN verdicts ON measured.source IS NOT DISTINCT FROM verdicts.source
"""
