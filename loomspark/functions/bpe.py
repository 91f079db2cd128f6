"""Byte-level byte-pair encoding from a public vocabulary file, as a column function."""

from __future__ import annotations

import heapq
import json
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that a word's merges may be remembered for, in one Python worker.
REMEMBERED = 1 << 16


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where it is printable Latin-1, else one from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in own}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class Vocabulary:
    """Ids, merge ranks and the split pattern of a tokenizer file of the public JSON format (model BPE, byte-level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.pattern = regex.compile(_pattern(spec.get("pre_tokenizer") or {}))
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: str) -> list[str]:
        """Symbols of a piece: adjacent pairs join by least rank, the leftmost of equal ones first."""
        symbols: list[str | None] = list(piece)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue  # one of the two has been joined since
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(symbols) and (r := self.rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens. A symbol that the vocabulary lacks is an error."""
        out: list[int] = []
        for m in self.pattern.finditer(text):
            word = m[0]
            found = self.known.get(word)
            if found is None:
                found = [self.ids[s] for s in self.merged("".join(self.letters[b] for b in word.encode()))]
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
            out += found
        return out


#: Fixed value: the split pattern that byte-level pre-tokenizers use where the file names none.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pattern(step: dict) -> str:
    for part in step.get("pretokenizers", [step]):
        if part.get("type") == "Split" and "Regex" in part.get("pattern", {}):
            return part["pattern"]["Regex"] + r"|[\s\S]"  # what the pattern leaves out stands between its matches
    return PATTERN


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and process."""
    return Vocabulary(path)


def token_ids(c: Column, path: str) -> Column:
    """Ids (array<int>) of a text column; null stays null. The file must be readable at `path` on every executor."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        own = vocabulary(path)
        return texts.map(lambda t: None if t is None else own.encode(t))

    return encode(c)


def text_of(ids: Column, path: str) -> Column:
    """The bytes that an array of ids stands for; null stays null."""

    @F.pandas_udf(T.BinaryType())
    def decode(rows: pd.Series) -> pd.Series:
        own = vocabulary(path)
        symbols = {i: s for s, i in own.ids.items()}
        bytes_ = {letter: b for b, letter in own.letters.items()}
        return rows.map(lambda ids: None if ids is None else bytes(bytes_[c] for i in ids for c in symbols[i]))

    return decode(ids)
