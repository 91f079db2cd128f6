"""JPEG files made here, whole and damaged."""

import random
import struct

import pytest

from loomspark.sources import files, jpeg

#: One table for everything: 255 codes of eight bits.
TABLE = bytes([0, 0, 0, 0, 0, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(255))


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 8)

    def number(self, v, size):
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        out = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return out.replace(b"\xff", b"\xff\x00")


def segment(kind, body):
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def coefficients(rng):
    return [rng.randint(-40, 40)] + [rng.choice([0, 0, 0, 0, rng.randint(-9, 9)]) if k < 50 or rng.random() < 0.1 else 0 for k in range(1, 64)]


def ac_symbols(w, block, band, low=0):
    """Codes of a band's coefficients without their lowest bits; returns whether the block is all zeros."""
    values = [int(v / (1 << low)) for v in block]  # towards zero
    run = 0
    last = max((k for k in range(band[0], band[1] + 1) if values[k]), default=None)
    if last is None:
        return False
    for k in range(band[0], last + 1):
        if not values[k]:
            run += 1
            continue
        while run > 15:
            w.symbol(0xF0)
            run -= 16
        size = abs(values[k]).bit_length()
        w.symbol(run << 4 | size)
        w.number(values[k], size)
        run = 0
    if last < band[1]:
        w.symbol(0)
    return True


def baseline(rng, width, height, sampling=((1, 1),), restart=0):
    most = max(a for a, _ in sampling), max(b for _, b in sampling)
    units = -(-width // (8 * most[0])) * -(-height // (8 * most[1]))
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling))
    head = bytes([len(sampling)]) + b"".join(bytes([i, 0]) for i in range(len(sampling))) + bytes([0, 63, 0])
    scan, w, before, marks = b"", Writer(), [0] * len(sampling), 0
    for unit in range(units):
        if restart and unit and unit % restart == 0:
            scan += w.done() + bytes([0xFF, 0xD0 + marks % 8])
            w, before, marks = Writer(), [0] * len(sampling), marks + 1
        for i, (a, b) in enumerate(sampling):
            for _ in range(a * b if len(sampling) > 1 else 1):
                block = coefficients(rng)
                difference = block[0] - before[i]
                before[i] = block[0]
                size = abs(difference).bit_length()
                w.symbol(size)
                w.number(difference, size)
                if not ac_symbols(w, block, (1, 63)):
                    w.symbol(0)
    scan += w.done()
    tables = segment(0xC4, b"\x00" + TABLE) + segment(0xC4, b"\x10" + TABLE)
    interval = segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + tables + segment(0xC0, frame) + interval + segment(0xDA, head) + scan + b"\xff\xd9"


def progressive(rng, width, height):
    """Grey: the first coefficients in two scans, two bands, and one refinement of a band."""
    n = -(-width // 8) * -(-height // 8)
    blocks = [coefficients(rng) if rng.random() < 0.7 else [rng.randint(-9, 9)] + [0] * 63 for _ in range(n)]
    scans = []

    def scan(first, last, high, low, w):
        scans.append(segment(0xDA, bytes([1, 0, 0, first, last, high << 4 | low])) + w.done())

    w, before = Writer(), 0
    for block in blocks:
        value = block[0] >> 1
        size = abs(value - before).bit_length()
        w.symbol(size)
        w.number(value - before, size)
        before = value
    scan(0, 0, 0, 1, w)
    w = Writer()
    for block in blocks:
        w.put(block[0] & 1, 1)
    scan(0, 0, 1, 0, w)
    for band, low in (((1, 5), 0), ((6, 63), 1)):
        w, ended = Writer(), 0

        def flush(w, n):
            while n:
                r = min(n.bit_length() - 1, 14)
                w.symbol(r << 4)
                w.put(n - (1 << r) if n < 2 << r else (1 << r) - 1, r)
                n -= min(n, (2 << r) - 1)

        for block in blocks:
            own = Writer()
            values = [int(v / (1 << low)) for v in block]
            last = max((k for k in range(band[0], band[1] + 1) if values[k]), default=None)
            if last is None:
                ended += 1
                continue
            flush(w, ended)
            ended = 0
            run = 0
            for k in range(band[0], last + 1):
                if not values[k]:
                    run += 1
                    continue
                while run > 15:
                    own.symbol(0xF0)
                    run -= 16
                size = abs(values[k]).bit_length()
                own.symbol(run << 4 | size)
                own.number(values[k], size)
                run = 0
            w.bits += own.bits
            if last < band[1]:
                ended = 1
        flush(w, ended)
        scan(*band, 0, low, w)
    w, band = Writer(), (6, 63)  # the lowest bit of the second band, with an end of block for each block
    for block in blocks:
        old = {k for k in range(6, 64) if abs(block[k]) > 1}
        new = [k for k in range(6, 64) if abs(block[k]) == 1]
        run, waiting = 0, []
        for k in range(6, (new[-1] if new else 5) + 1):
            if k in old:
                waiting.append(abs(block[k]) & 1)
            elif abs(block[k]) == 1:
                w.symbol(run << 4 | 1)
                w.put(int(block[k] > 0), 1)
                w.bits += waiting
                run, waiting = 0, []
            else:
                run += 1
                if run == 16 and any(x > k for x in new):
                    w.symbol(0xF0)
                    w.bits += waiting
                    run, waiting = 0, []
        end = new[-1] if new else 5
        if end < 63:
            w.symbol(0)
            w.bits += [abs(block[k]) & 1 for k in range(end + 1, 64) if k in old]
    scan(*band, 1, 0, w)
    frame = struct.pack(">BHHB", 8, height, width, 1) + bytes([0, 0x11, 0])
    tables = segment(0xC4, b"\x00" + TABLE + b"\x10" + TABLE)
    return b"\xff\xd8" + tables + segment(0xC2, frame) + b"".join(scans) + b"\xff\xd9"


def made():
    rng = random.Random(6)
    return {
        "grey": baseline(rng, 100, 75), "colour": baseline(rng, 90, 50, ((2, 2), (1, 1), (1, 1))), "restarts": baseline(rng, 200, 60, restart=7),
        "one block": baseline(rng, 3, 3), "odd sampling": baseline(rng, 70, 41, ((2, 1), (1, 1), (1, 2))), "progressive": progressive(rng, 90, 77),
    }


@pytest.mark.parametrize("name", list(made()))
def test_whole_files_pass(name):
    data = made()[name]
    assert jpeg.walk(data) is True and files._whole(data)
    assert jpeg.walk(data + b"trailing bytes") is True


@pytest.mark.parametrize("name", list(made()))
def test_files_that_end_early_fail(name):
    data = made()[name]
    for n in [*range(2, len(data), max(1, len(data) // 60)), len(data) - 1, len(data) - 2, len(data) - 3]:
        assert not files._whole(data[:n]), n
        assert not files._whole(data[: max(2, n - 40)] + b"\xff\xd9")  # cut, with an end mark


@pytest.mark.parametrize("name", ["grey", "colour", "restarts", "progressive"])
def test_files_with_a_gap_in_the_middle_fail(name):
    """The end mark is there in all of them."""
    data, rng = made()[name], random.Random(7)
    begin = data.index(b"\xff\xda") + 12
    for _ in range(60):
        at = rng.randint(begin, len(data) - 200)
        gap = rng.randint(30, 150)
        damaged = data[:at] + data[at + gap :]
        assert damaged.endswith(b"\xff\xd9") and not files._whole(damaged), (at, gap)


def test_missing_scans_and_other_codings():
    rng = random.Random(8)
    grey = baseline(rng, 20, 20)
    at = grey.index(b"\xff\xda")
    assert jpeg.walk(grey[:at] + b"\xff\xd9") is False  # no scan at all
    assert jpeg.walk(grey.replace(b"\xff\xc0", b"\xff\xc9")) is None  # arithmetic codes: not walked
    assert jpeg.walk(b"\xff\xd8") is False and jpeg.walk(b"\xff\xd8\xff\xd9") is False
    for _ in range(300):  # random damage never raises
        broken = bytearray(grey)
        for _ in range(5):
            broken[rng.randrange(2, len(broken))] = rng.randrange(256)
        assert jpeg.walk(bytes(broken)) in (True, False, None)
