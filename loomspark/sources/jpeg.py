"""Reads a JPEG file through to its end: all scans with all their blocks, without computing pixels."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

#: Any marker in entropy-coded data but stuffed zeros and restarts, and those restarts.
_MARKER = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+([\xd0-\xd7])")
#: Frames that can be walked: baseline, extended and progressive, all with Huffman codes.
SEQUENTIAL, PROGRESSIVE = (0xC0, 0xC1), 0xC2


class Broken(ValueError):
    """What the file says doesn't fit its data."""


@dataclass
class Component:
    across: int
    down: int
    blocks: tuple[int, int] = (0, 0)  # columns and rows that a scan of its own has
    stride: int = 0  # columns with those that interleaved scans add
    known: list[int] = field(default_factory=list)  # coefficients that aren't zero, a bit each, for each block
    scans: int = 0


class Codes:
    """A Huffman table as one entry for each 16 bits that may come: length of the code in front of them, and its symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lengths, self.symbols = bytearray(1 << 16), bytearray(1 << 16)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                first, width = code << 16 - length, 1 << 16 - length
                if first + width > 1 << 16:
                    raise Broken("codes overflow")
                self.lengths[first : first + width] = bytes([length]) * width
                self.symbols[first : first + width] = bytes([symbol]) * width
                code += 1
            at += n
            code <<= 1


class Bits:
    """Bits of one restart interval."""

    def __init__(self, stuffed: bytes):
        data = stuffed.rstrip(b"\xff").replace(b"\xff\x00", b"\xff") if stuffed.endswith(b"\xff") else stuffed.replace(b"\xff\x00", b"\xff")
        self.end, self.data, self.at = 8 * len(data), data + b"\0\0\0\0", 0

    def symbol(self, codes: Codes) -> int:
        at = self.at
        window = int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> 8 - (at & 7) & 0xFFFF
        length = codes.lengths[window]
        self.at = at + length
        if not length or self.at > self.end:
            raise Broken("no code")
        return codes.symbols[window]

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise Broken("data ends")

    def take(self, n: int) -> int:
        self.skip(n)
        first = self.at - n
        return int.from_bytes(self.data[first >> 3 : (self.at >> 3) + 1], "big") >> 8 - (self.at & 7) & (1 << n) - 1

    def close(self) -> None:
        if self.end - self.at >= 16:
            raise Broken("data is left over")


def sequential_block(bits: Bits, dc: Codes, ac: Codes) -> None:
    size = bits.symbol(dc)
    if size > 16:
        raise Broken("a difference of over 16 bits")
    bits.skip(size)
    k = 1
    while k < 64:
        code = bits.symbol(ac)
        run, size = code >> 4, code & 15
        if size:
            k += run + 1
            bits.skip(size)
        elif run == 15:
            k += 16
        else:
            return
        if k > 64:
            raise Broken("over 64 coefficients")


def first_pass(bits: Bits, ac: Codes, band: tuple[int, int], run_left: int, known: list[int], block: int) -> int:
    """One block of a progressive scan that brings coefficients; the number of blocks that its end also ends."""
    if run_left:
        return run_left - 1
    k = band[0]
    while k <= band[1]:
        code = bits.symbol(ac)
        run, size = code >> 4, code & 15
        if size:
            k += run
            if k > band[1]:
                raise Broken("over the band")
            bits.skip(size)
            known[block] |= 1 << k
            k += 1
        elif run == 15:
            k += 16
        else:
            return (1 << run) - 1 + (bits.take(run) if run else 0)
    if k > band[1] + 1:
        raise Broken("over the band")
    return 0


def refining_pass(bits: Bits, ac: Codes, band: tuple[int, int], run_left: int, known: list[int], block: int) -> int:
    """One block of a progressive scan that adds a bit to what is known, and brings new coefficients between."""
    k, seen = band[0], known[block]
    if not run_left:
        while k <= band[1]:
            code = bits.symbol(ac)
            run, size = code >> 4, code & 15
            if size > 1:
                raise Broken("more than a bit")
            if size:
                bits.skip(1)
            elif run < 15:
                run_left = (1 << run) + (bits.take(run) if run else 0)
                break
            while k <= band[1]:
                if seen >> k & 1:
                    bits.skip(1)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if size:
                if k > band[1]:
                    raise Broken("over the band")
                known[block] |= 1 << k
            k += 1
    if run_left:
        bits.skip((seen >> k & (1 << max(0, band[1] - k + 1)) - 1).bit_count())
        run_left -= 1
    return run_left


class Walk:
    """State of one file: its frame, tables and restart interval."""

    def __init__(self) -> None:
        self.kind, self.size, self.components, self.codes, self.restart = None, (0, 0), {}, {}, 0
        self.most = (1, 1)

    def frame(self, kind: int, body: bytes) -> None:
        _, height, width, n = struct.unpack(">BHHB", body[:6])
        self.kind, self.size = kind, (width, height)
        if not width or not height or not n or len(body) < 6 + 3 * n:
            raise Broken("no frame")
        self.components = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)}
        parts = self.components.values()
        if any(not 1 <= x <= 4 for c in parts for x in (c.across, c.down)):
            raise Broken("no sampling")
        self.most = max(c.across for c in parts), max(c.down for c in parts)
        for c in parts:
            c.blocks = tuple(-(-(-(-size * own // most)) // 8) for size, own, most in zip(self.size, (c.across, c.down), self.most))
            units = self.units()
            c.stride = units[0] * c.across
            c.known = [0] * (c.stride * units[1] * c.down) if kind == PROGRESSIVE else []

    def units(self) -> tuple[int, int]:
        return tuple(-(-size // (8 * most)) for size, most in zip(self.size, self.most))

    def tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            if len(counts) < 16 or at + 17 + n > len(body):
                raise Broken("a table ends")
            self.codes[body[at]] = Codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        if self.kind is None or len(head) < 4 + 2 * n or not n:
            raise Broken("no frame")
        parts = [(self.components[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        band, step = (head[1 + 2 * n], head[2 + 2 * n]), head[3 + 2 * n]
        whole = n > 1
        columns, rows = self.units() if whole else parts[0][0].blocks
        intervals = _RESTART.split(data)
        marks = [m[0] - 0xD0 for m in intervals[1::2]]
        units, each = columns * rows, self.restart or columns * rows
        if marks != [i % 8 for i in range(-(-units // each) - 1)]:
            raise Broken("restarts are missing")
        done = 0
        for stuffed in intervals[::2]:
            bits, run_left = Bits(stuffed), 0
            for unit in range(done, min(done + each, units)):
                row, column = divmod(unit, columns)
                for c, dc, ac in parts:
                    for place in range(c.across * c.down if whole else 1):
                        if self.kind != PROGRESSIVE:
                            sequential_block(bits, self.codes[dc], self.codes[16 + ac])
                        elif not band[0]:
                            if step >> 4:
                                bits.skip(1)
                            else:
                                bits.skip(bits.symbol(self.codes[dc]))
                        else:
                            if whole or not band[0] <= band[1] < 64:
                                raise Broken("no band")
                            one = refining_pass if step >> 4 else first_pass
                            run_left = one(bits, self.codes[16 + ac], band, run_left, c.known, row * c.stride + column)
            bits.close()
            done += each
        for c, *_ in parts:
            c.scans += not band[0]


def walk(data: bytes) -> bool | None:
    """Whether every scan is there to its last block, and the end mark behind them; None for codings that aren't walked."""
    state, at = Walk(), 2
    try:
        while True:
            if data[at] != 0xFF:
                return False
            while data[at + 1] == 0xFF:
                at += 1
            kind = data[at + 1]
            at += 2
            if kind == 0xD9:
                return bool(state.components) and all(c.scans for c in state.components.values())
            if kind == 0x01 or 0xD0 <= kind <= 0xD7:
                continue
            n = struct.unpack(">H", data[at : at + 2])[0]
            body = data[at + 2 : at + n]
            if n < 2 or len(body) < n - 2:
                return False
            at += n
            if kind in SEQUENTIAL or kind == PROGRESSIVE:
                state.frame(kind, body)
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return None
            elif kind == 0xC4:
                state.tables(body)
            elif kind == 0xDD:
                state.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xDA:
                end = _MARKER.search(data, at)
                if end is None:
                    return False
                state.scan(body, data[at : end.start()])
                at = end.start()
    except (Broken, IndexError, KeyError, struct.error):
        return False
