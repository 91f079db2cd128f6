"""Text, table and file-pair readers."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources import jpeg


def prompts(spark: SparkSession, paths: list[str] | str, without: str | None = None) -> DataFrame:
    """Non-blank lines, trimmed (column prompt), optionally without those that contain a word."""
    rows = spark.read.text(paths).select(F.trim("value").alias("prompt")).where("prompt <> ''")
    return rows.where(~F.contains("prompt", F.lit(without))) if without else rows


def words_of(text: Column) -> Column:
    """Trimmed non-blank lines of one multi-line text."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def score_log(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Valid lines of tab-separated score logs: file, line_no (within the file), instruction, score."""
    rows = spark.read.text(paths, wholetext=True).select("_metadata.file_path", "value")
    lines = rows.select(F.col("file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parse_score_lines(lines)


def parse_score_lines(lines: DataFrame) -> DataFrame:
    """From (file, line_no, line): lines of two fields that are no trailer, with the score parsed."""
    fields = F.split(F.trim("line"), "\t")
    good = lines.where(~F.contains("line", F.lit("final score")) & (F.size(fields) == 2))
    return good.select("file", F.col("line_no").cast("long").alias("line_no"), fields[0].alias("instruction"), F.from_json(fields[1], "array<double>").alias("score")).where("score IS NOT NULL")


def multi_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, labels (array), split: rows of two or three columns, labels written as "[a, b]"; the split defaults to train."""
    rows = spark.read.csv(path, header=False, schema="path string, labels string, split string", mode="PERMISSIVE", quote='"', ignoreLeadingWhiteSpace=True)
    return rows.select("path", label_list(F.col("labels")).alias("labels"), F.coalesce(F.trim("split"), F.lit("train")).alias("split"))


def label_list(c: Column) -> Column:
    return F.split(F.translate(c, "[]", ""), ", ")


def label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """key, label_ids of a JSON object of arrays."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("key", "label_ids"))


def json_lines(spark: SparkSession, paths: list[str] | str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(paths)


def files(spark: SparkSession, root: str, name_filter: str | None = None, payload: bool = False) -> DataFrame:
    """path, name, folder, stem (and payload) of all files under a root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.load(root)
    name = F.element_at(F.split("path", "/"), -1)
    columns = ["path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")]
    return rows.select(*columns, *(["content"] if payload else []))


def edit_pairs(listed: DataFrame) -> DataFrame:
    """In and out files of one folder and instruction: folder (the task), instruction, source, edited; `_in` and `_out` may stand anywhere in the name."""
    side = lambda mark, out: listed.where(F.contains("name", F.lit(mark))).select("folder", F.replace("stem", F.lit(mark), F.lit("")).alias("instruction"), F.col("path").alias(out))
    return side("_in", "source").join(side("_out", "edited"), ["folder", "instruction"])


def templates(spark: SparkSession, root: str) -> DataFrame:
    """name, text of every text file."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("_metadata.file_name", "value")
    return rows.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))


def concatenated(texts: DataFrame, order: str, text: str) -> DataFrame:
    """All texts in order as one (text); meant for prompt files, which are few."""
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"))


def annotations(objects: Column, classes: int) -> Column:
    """Three multi-hot vectors of the classes that have a small, medium and large object (category, area)."""
    from loomspark.functions.geometry import area_band
    from loomspark.functions.vector import multi_hot

    band = lambda i: multi_hot(F.transform(F.filter(objects, lambda o: area_band(o["area"]) == i), lambda o: o["category"]), classes)
    return F.array(*[band(i) for i in range(3)])


@F.pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]))
def image_size(payloads: pd.Series) -> pd.DataFrame:
    """Width and height from a PNG, GIF, BMP, WebP or JPEG header; null where none is found."""
    return pd.DataFrame([_size(p) or (None, None) for p in payloads], columns=["w", "h"]).astype("Int32")


@F.pandas_udf(T.BooleanType())
def image_whole(payloads: pd.Series) -> pd.Series:
    """Whether a PNG, GIF, BMP, WebP or JPEG is there from its header to its end; PNG data is decompressed and its checksums are verified, and a JPEG's scans are read to their last blocks."""
    return payloads.map(_whole).astype(bool)


def _whole(data: bytes | None) -> bool:
    size = _size(data)
    if size is None:
        return False
    data = bytes(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, pixels = 8, zlib.decompressobj()
        while at + 12 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            body = data[at + 4 : at + 8 + n]
            if data[at + 8 + n : at + 12 + n] != zlib.crc32(body).to_bytes(4, "big"):
                return False
            if body[:4] == b"IDAT":
                try:
                    pixels.decompress(body[4:])
                except zlib.error:
                    return False
            if body[:4] == b"IEND":
                return pixels.eof
            at += 12 + n
        return False
    if data[:3] == b"GIF":
        return data.rstrip(b"\0")[-1:] == b";"
    if data[:2] == b"BM":
        return len(data) >= int.from_bytes(data[2:6], "little")
    if data[:4] == b"RIFF":
        return len(data) >= 8 + int.from_bytes(data[4:8], "little")
    found = jpeg.walk(data)
    return data.rstrip(b"\0")[-2:] == b"\xff\xd9" if found is None else found


def _size(data: bytes | None) -> tuple[int, int] | None:
    if not data:
        return None
    data = bytes(data)
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                kind = data[at + 1]
                if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD9:
                    at += 1 if kind == 0xFF else 2
                    continue
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except struct.error:
        return None
    return None
