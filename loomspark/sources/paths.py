"""Path lists: brace ranges, lists with separators, several roots."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_RANGE = re.compile(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?\Z")


def expand_braces(pattern: str) -> list[str]:
    """`a{000..002}b{x,y}` to its strings, left group slowest; a group without comma or range stays as it is."""
    depth, begin = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                begin = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                choices = _choices(pattern[begin + 1 : i])
                rest = expand_braces(pattern[i + 1 :])
                if choices is None:
                    return [pattern[: i + 1] + r for r in rest]
                return [pattern[:begin] + c + r for c in choices for r in rest]
    return [pattern]


def _choices(body: str) -> list[str] | None:
    if m := _RANGE.match(body):
        low, high, step = m[1], m[2], int(m[3] or 1)
        step = abs(step) or 1
        width = max(len(low), len(high)) if low.lstrip("-").startswith("0") and len(low) > 1 or high.lstrip("-").startswith("0") and len(high) > 1 else 0
        a, b = int(low), int(high)
        numbers = range(a, b + 1, step) if a <= b else range(a, b - 1, -step)
        return [str(n).zfill(width) for n in numbers]
    parts, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(body[last:i])
            last = i + 1
    if not parts:
        return None
    return [x for p in [*parts, body[last:]] for x in expand_braces(p)]


def expand(urls: str | list[str]) -> list[str]:
    """A string is split at `::` and its braces expanded; a list is taken as it is."""
    return [x for part in urls.split("::") for x in expand_braces(part)] if isinstance(urls, str) else list(urls)


def listed(spark: SparkSession, urls: str | list[str], suffix: str | None = ".tar") -> list[str]:
    """Paths for the patterns, in order, repeats kept: patterns with `*` by the file system that Spark reads, others expanded."""
    out = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for url in expand(urls):
        if "*" in url or "?" in url:
            path = hadoop.Path(url)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            found = fs.globStatus(path) or []
            out += sorted(f.getPath().toString() for f in found)
        else:
            out.append(url)
    return [p for p in out if suffix is None or p.endswith(suffix)]
