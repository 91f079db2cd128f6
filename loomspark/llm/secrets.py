"""Secret scans: fixed patterns plus sliding-window entropy, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import pack_columns

#: Kinds in the order in which ties at one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs, so the bound equals dropping the shorter ones
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6

#: Candidate strings for the entropy windows (a name before = is none of them), the window's length, and least bits per character of each class.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "mixed": 3.9}
#: What is known to be no secret: placeholders and alphabets, which windows must not touch, and whole candidates that are
#: identifiers with dashes, one repeated unit, or lower-case paths.
ALLOW_WORDS = r"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|lorem|0123456789|abcdefghijkl|qwertyuiop"
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.{1,6})\1{3,}.{0,5}$",
    r"^(?=[^/]*/[^/]*/)[a-z0-9/_-]+$",
)
BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of long, by blocks, so that the cost stays near linear in its length."""
    zero = F.array(F.lit(0).cast("long"))

    def running(block: Column, value) -> Column:
        return F.aggregate(block, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1), lambda b: running(F.slice(values, b * BLOCK + 1, BLOCK), lambda x: x))
    both = F.struct(blocks.alias("b"))
    inner = F.transform(F.array(both), lambda x: F.struct(x["b"].alias("b"), running(x["b"], lambda y: F.element_at(y, -1)).alias("at")))
    sums = F.transform(inner, lambda x: F.flatten(F.transform(x["b"], lambda y, i: F.transform(F.slice(y, 2, F.size(y) - 1), lambda v: v + F.get(x["at"], i)))))
    return F.when(F.size(values) > 0, F.element_at(sums, 1)).otherwise(F.array().cast("array<bigint>"))


def located(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Adds `out`: array of (s, e, m, g) for the leftmost non-overlapping matches; s and e in code points, m the match, g the group."""
    df = df.withColumn("__m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("__m") > 0
    gaps = F.when(some, F.split(text, pattern, -1))
    df = df.withColumn("__gap", F.transform(gaps, lambda x: F.length(x).cast("long")))
    df = df.withColumn("__step", F.when(some, F.transform("__m", lambda _, i: F.get("__gap", i) + F.when(i > 0, F.length(F.get("__m", i - 1))).otherwise(0))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__at", F.when(some, prefix_sums(F.col("__step"))).otherwise(F.array().cast("array<bigint>")))
    inner = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("__m")
    df = df.withColumn("__g", inner)
    spans = F.transform("__m", lambda m, i: F.struct(F.get("__at", i).alias("s"), (F.get("__at", i) + F.length(m)).alias("e"), m.alias("m"), F.get("__g", i).alias("g")))
    return df.withColumn(out, spans).drop("__m", "__gap", "__step", "__at", "__g")


def _bumped(counts: Column, at: Column, by: int) -> Column:
    """The array with one element changed; slices are copied whole, which costs far less than a function of each element."""
    return F.concat(F.slice(counts, 1, at), F.array(F.get(counts, at) + by), F.slice(counts, at + 2, 128))


def _entropy_span(word: Column, start: Column, least: Column) -> Column:
    """From the first to the last window of at least `least` bits, or null.

    The aggregate keeps a count for each character of the window and the sum of c*log2(c); one step adds
    a character, takes one off, and adjusts both.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    empty = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).cast("double").alias("t"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def seen(acc: Column) -> tuple[Column, Column]:
        """First and last with the window that ends after the characters taken so far."""
        high = (acc["i"] >= WINDOW) & (math.log2(WINDOW) - acc["t"] / WINDOW >= least)
        return F.when(high & (acc["first"] < 0), acc["i"] - WINDOW).otherwise(acc["first"]).alias("first"), F.when(high, acc["i"]).otherwise(acc["last"]).alias("last")

    def step(codes_: Column, acc: Column, new: Column) -> Column:
        i = acc["i"]
        old = F.when(i >= WINDOW, F.get(codes_, i - WINDOW)).otherwise(F.lit(-1))
        same = old == new
        up, down = F.get(acc["n"], new), F.get(acc["n"], old)
        t = acc["t"] + F.when(same, 0.0).otherwise(
            F.get(table, up + 1) - F.get(table, up) + F.when(old >= 0, F.get(table, down - 1) - F.get(table, down)).otherwise(0.0)
        )
        added = _bumped(acc["n"], new, 1)
        counts = F.when(same, acc["n"]).when(old >= 0, _bumped(added, old, -1)).otherwise(added)
        return F.struct(counts.alias("n"), t.alias("t"), (i + 1).alias("i"), *seen(acc))

    # the array of codes is bound once, for the steps look back into it
    done = F.transform(F.array(codes), lambda cs: F.aggregate(cs, empty, lambda acc, new: step(cs, acc, new), lambda acc: F.struct(*seen(acc))))
    return F.transform(done, lambda x: F.when(x["first"] >= 0, F.struct((start + x["first"]).alias("s"), (start + x["last"]).alias("e"))))[0]


def _pieces(x: Column) -> Column:
    """Array of (s, m): what a candidate's allowed words leave of it."""
    none = F.array().cast("array<struct<s:bigint,m:string>>")
    begin = F.struct(x["s"].alias("at"), none.alias("out"))
    words = F.concat(F.transform(F.regexp_extract_all(x["m"], F.lit(ALLOW_WORDS), F.lit(0)), lambda w: F.length(w).cast("long")), F.array(F.lit(0).cast("long")))
    both = F.arrays_zip(F.split(x["m"], ALLOW_WORDS, -1).alias("m"), words.alias("n"))
    cut = F.aggregate(
        both, begin, lambda acc, p: F.struct((acc["at"] + F.length(p["m"]) + p["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), p["m"].alias("m")))).alias("out")), lambda acc: acc["out"]
    )
    return F.when(x["m"].rlike(ALLOW_WORDS), cut).otherwise(F.array(F.struct(x["s"].alias("s"), x["m"].alias("m"))))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds `out`: array of (s, e, kind) sorted by start, then kind as listed: assign, access, hex, entropy.

    Null text counts as empty. Offsets are code points, ends exclusive, over the whole text. The entropy
    kind covers, in a run of 20 or more candidate characters with letters and digits, the windows whose
    Shannon entropy reaches the least bits of the run's class (hex or mixed), unless the allow-list has the run. A
    placeholder or alphabet inside a run takes away the windows that touch it; what lies between is a run of its own.
    """
    docs, unpack = pack_columns(docs, text_col)
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("candidate", CANDIDATE, 0)):
        df = located(df, "__text", pattern, f"__{kind}", group)
    df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(x["g"]) >= MIN_ASSIGNED))

    def suspect(x: Column) -> Column:
        bad = (F.length(x["m"]) >= WINDOW) & x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")
        for allowed in ALLOW:
            bad = bad & ~x["m"].rlike(allowed)
        return bad

    df = df.withColumn("__candidate", F.filter("__candidate", suspect))
    df = df.withColumn("__candidate", F.filter(F.flatten(F.transform("__candidate", _pieces)), suspect))
    least = lambda m: F.when(m.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).otherwise(LEAST_BITS["mixed"])
    # the least entropy is found once for each candidate, not at each of its characters
    df = df.withColumn("__candidate", F.transform("__candidate", lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), least(x["m"]).alias("least"))))
    df = df.withColumn("__entropy", F.filter(F.transform("__candidate", lambda x: _entropy_span(x["m"], x["s"], x["least"])), lambda x: x.isNotNull()))
    kinds = ("assign", "access", "hex", "entropy")

    def ranked(rank: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"))

    spans = F.concat(*[F.transform(f"__{kind}", ranked(rank)) for rank, kind in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    listed = F.transform(F.array_sort(spans), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(names, x["k"]).alias("kind")))
    return unpack(df.withColumn(out, listed).drop("__text", "__candidate", *[f"__{k}" for k in kinds]))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Digest of every document's spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = found.select("doc_id", "secret_spans")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), count("entropy"))
