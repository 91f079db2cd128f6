"""Different texts whose 64-bit hashes were made equal are kept apart."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, shingles, substrings

#: Primes of xxHash64.
P1, P2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
M = (1 << 64) - 1


def lane(value: int) -> int:
    value = value & M
    return ((value << 31 | value >> 33) & M) * P1 & M


def colliding(seed: int = 42) -> tuple[str, str]:
    """Two texts of 40 words that differ in two words and have one xxHash64: the second word undoes what the first one changes."""
    rng = random.Random(1)
    start = seed + P1 + P2
    number = lambda b: int.from_bytes(b, "little")
    a, b = b"firstone", b"otherone"
    target = lane(start + number(a) * P2) + number(b) * P2
    while True:
        c = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=8))
        d = ((target - lane(start + number(c) * P2)) * pow(P2, -1, 1 << 64) & M).to_bytes(8, "little")
        if all(33 <= x <= 126 for x in d):
            break
    filler, tail = b" between those in words ", b" " + b" ".join(b"tail%d" % i for i in range(34))
    return tuple((x + filler + y + tail).decode() for x, y in ((a, b), (c, d)))


@pytest.fixture(scope="module")
def texts(spark):
    first, second = colliding()
    assert first != second and len(first.split()) == len(second.split()) == 40
    assert xxhash.xxh64_intdigest(first, 42) == xxhash.xxh64_intdigest(second, 42)
    rows = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    assert rows.select(F.countDistinct(F.xxhash64("text"))).first()[0] == 1
    return rows


def test_repeats_of_texts_with_one_hash(spark, texts):
    """The texts share 34 words in a row, one fewer than a window."""
    assert [r["n_removed"] for r in substrings.remove_repeats(texts).collect()] == [0, 0]
    again = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(texts.union(texts.where("doc_id = 1"))).collect()}
    assert again == {1: 40, 2: 0}


def test_contamination_of_texts_with_one_hash(spark, texts):
    first = texts.first()["text"]
    item = spark.createDataFrame([(7, " ".join(first.split()[:11]))], "item_id long, text string")
    found = decontaminate.with_digest(decontaminate.find_contamination(texts, item))
    assert {r["doc_id"]: (r["contaminated"], r["n_hit"]) for r in found.collect()} == {1: (True, 11), 2: (False, 0)}


def test_near_copies_with_one_key(spark):
    """Signs of the Thue-Morse sequence make any polynomial modulo 2**64 vanish; words in between keep the texts far apart."""
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ([w for i, s in enumerate(signs) for w in ("ab"[s ^ flip], f"filler{i}")] for flip in (0, 1))
    one, two = " ".join(one), " ".join(two)
    keys = shingles.shingles([one.encode(), two.encode()])[0]
    assert one != two and keys[0] == keys[1]
    rows = spark.createDataFrame([(1, one), (2, two), (3, one.upper()), (4, two + " end"), (5, "plain")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(rows).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
