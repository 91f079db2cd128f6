"""Writers: rolling tables, score logs, summaries, quarantine and split manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_rolling(df: DataFrame, path: str, rows: int = 5000, part: str | None = None, mode: str = "overwrite") -> None:
    """Parquet files of at most `rows` rows, one folder a part if a column is named."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", rows)
    (writer.partitionBy(part) if part else writer).parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Appends `instruction<tab>[a, b]` lines."""
    line = F.concat(F.col("instruction"), F.lit("\t["), F.array_join(F.transform("score", lambda x: x.cast("string")), ", "), F.lit("]"))
    df.select(line.alias("value")).write.mode("append").text(path)


def write_summary(report: DataFrame, path: str) -> None:
    """Summaries go to a table of their own, never among the rows."""
    report.write.mode("overwrite").json(path)


def quarantined(df: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `_error`). A null condition counts as bad."""
    broken = F.coalesce(bad, F.lit(True))
    return df.where(~broken), df.where(broken).withColumn("_error", reason)


def write_manifest(df: DataFrame, path: str, key: str, part: str) -> None:
    df.select(key, part).write.mode("overwrite").partitionBy(part).parquet(path)


def audit_text(instruction: Column, answer: Column, scores: Column) -> Column:
    """The text kept beside a sample: instruction, judge's answer, scores."""
    return F.concat_ws("\n", instruction, answer, F.array_join(F.transform(scores, lambda x: x.cast("string")), ", "))
