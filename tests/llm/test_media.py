"""Media columns against a decoder of our own that works bit by bit, as the format's standard describes it."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sparkwarden.llm import media
from tests.llm.test_operators import docs, none, odd_texts, words  # noqa: F401


def slow_decode(jpeg):
    """Coefficients of each component in raster order of its blocks, with least and greatest code per length."""
    at, quant, huff, restart, frame, comment = 2, {}, {}, 0, None, b""
    while True:
        assert jpeg[at] == 0xFF
        code, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC4:
            while body:
                counts, values, level, k, mins, maxs, first = body[1:17], body[17 : 17 + sum(body[1:17])], 0, 0, {}, {}, {}
                for n in range(1, 17):
                    if counts[n - 1]:
                        first[n], mins[n] = k, level
                        k += counts[n - 1]
                        level += counts[n - 1]
                        maxs[n] = level - 1
                    level *= 2
                huff[body[0]] = (mins, maxs, first, values)
                body = body[17 + sum(counts) :]
        elif code == 0xDB:
            quant[body[0]] = body[1:65]
        elif code == 0xC0:
            h, w = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15) for j in range(body[5])]
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xFE:
            comment = body
        elif code == 0xDA:
            use = {body[1 + 2 * j]: (body[2 + 2 * j] >> 4, 16 + (body[2 + 2 * j] & 15)) for j in range(body[0])}
            break
    hm, vm = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:
        hm = vm = 1
        frame = [(frame[0][0], 1, 1)]
    bits, done = [], 0

    def refill():
        nonlocal at, bits, done
        while not (jpeg[at] == 0xFF and 0xD0 <= jpeg[at + 1] <= 0xD7):
            at += 1
        at, bits, done = at + 2, [], 0

    def bit():
        nonlocal at, bits, done
        if done == len(bits):
            b = jpeg[at]
            at += 2 if b == 0xFF else 1
            bits, done = [b >> (7 - j) & 1 for j in range(8)], 0
        done += 1
        return bits[done - 1]

    def symbol(t):
        mins, maxs, first, values = huff[t]
        code = 0
        for n in range(1, 17):
            code = code * 2 + bit()
            if n in maxs and mins[n] <= code <= maxs[n]:
                return values[first[n] + code - mins[n]]
        raise ValueError

    def receive(n):
        v = 0
        for _ in range(n):
            v = v * 2 + bit()
        return v if n == 0 or v >= 2 ** (n - 1) else v - 2**n + 1

    wide, high = -(-w // (8 * hm)), -(-h // (8 * vm))
    out, last = collections.defaultdict(dict), collections.Counter()
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            refill()
            last.clear()
        for name, ch, cv in frame:
            for y in range(cv):
                for x in range(ch):
                    block, k = [0] * 64, 1
                    last[name] += receive(symbol(use[name][0]))
                    block[0] = last[name]
                    while k < 64:
                        s = symbol(use[name][1])
                        if s == 0:
                            break
                        k += s >> 4
                        if s != 0xF0:
                            block[k] = receive(s & 15)
                        k += 1
                    out[name][unit // wide * cv + y, unit % wide * ch + x] = block
    return [out[name] for name, _, _ in frame], comment, (w, h)


def slow_encode(width, height, factors, tables, restart, rng, several_scans=False):
    """A file of random coefficients, written bit by bit, and the coefficients."""
    hm, vm = max(f[0] for f in factors), max(f[1] for f in factors)
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    grids = []
    for ch, cv in factors:
        grid = {}
        for y in range(high * cv):
            for x in range(wide * ch):
                block = [0] * 64
                block[0] = rng.randrange(-900, 900)
                for k in rng.sample(range(1, 64), rng.choice([0, 1, 3, 20, 63])):
                    block[k] = rng.choice([-200, -3, -1, 1, 2, 100])
                grid[y, x] = block
        grids.append(grid)
    (dc, ac) = tables
    codes = [media.canonical(*t) for t in tables]

    def put(bits, table, symbol, value, size):
        n, code = codes[table][symbol]
        bits += f"{code:0{n}b}"
        if size:
            bits += f"{value if value > 0 else value + 2**size - 1:0{size}b}"
        return bits

    def block_bits(block, before):
        bits, d = "", block[0] - before
        bits = put(bits, 0, abs(d).bit_length(), d, abs(d).bit_length())
        zeros = 0
        for k in range(1, 64):
            if block[k] == 0:
                zeros += 1
                continue
            while zeros > 15:
                bits, zeros = put(bits, 1, 0xF0, 0, 0), zeros - 16
            size = abs(block[k]).bit_length()
            bits, zeros = put(bits, 1, zeros << 4 | size, block[k], size), 0
        return put(bits, 1, 0, 0, 0) if zeros else bits

    def scan(parts):
        comps = [(j, *factors[j]) for j in parts]
        if len(parts) == 1 and len(factors) > 1:
            j = parts[0]
            w, h = -(-(-(-width * factors[j][0] // hm)) // 8), -(-(-(-height * factors[j][1] // vm)) // 8)
            units = [[(j, y, x)] for y in range(h) for x in range(w)]
        else:
            units = [[(j, y * cv + b, x * ch + a) for j, ch, cv in comps for b in range(cv) for a in range(ch)] for y in range(high) for x in range(wide)]
        raw, bits, before = b"", "", collections.Counter()
        for n, unit in enumerate(units):
            if restart and n and n % restart == 0:
                bits += "1" * (-len(bits) % 8)
                raw += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                bits, before = "", collections.Counter()
            for j, y, x in unit:
                bits += block_bits(grids[j][y, x], before[j])
                before[j] = grids[j][y, x][0]
        bits += "1" * (-len(bits) % 8)
        raw += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        return media._marker(0xDA, bytes([len(parts), *(v for j in parts for v in (j + 1, 0)), 0, 63, 0])) + raw

    head = b"\xff\xd8" + media._marker(0xDB, bytes([0] + [2] * 64)) + media._marker(0xC4, b"\0" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1])
    head += media._marker(0xDD, struct.pack(">H", restart)) + media._marker(0xC0, struct.pack(">BHHB", 8, height, width, len(factors)) + bytes(v for j, (a, b) in enumerate(factors) for v in (j + 1, a << 4 | b, 0)))
    scans = [[j] for j in range(len(factors))] if several_scans else [list(range(len(factors)))]
    return head + b"".join(map(scan, scans)) + b"\xff\xd9", grids


OTHER_TABLES = (media.huffman_table({s: 1 + (7 * s) % 12 for s in range(12)}), media.huffman_table({0: 90, 0xF0: 3} | {r << 4 | s: 1 + (r * s) % 40 for r in range(16) for s in range(1, 11)}))


@pytest.mark.parametrize("n", [64, 128, 640, 64 * 65, 64 * 200])
def test_round_trip_and_the_slow_decoder_agree(n):
    payload = bytes(random.Random(n).getrandbits(8) for _ in range(n - 64)) + bytes(range(192, 256))
    jpeg = media.encode(payload)
    image, blocks = media.read_files([jpeg])[0]
    assert media.payload_of(image, blocks) == payload
    grids, comment, size = slow_decode(jpeg)
    flat = [v % 256 for k in sorted(grids[0]) for v in grids[0][k]]
    assert bytes(flat[:n]) == payload and comment == b"payload %d" % n and size == (image.width, image.height)


def test_zeros_and_long_texts_take_pieces(monkeypatch):
    payload = bytes(64 * 3) + b"\1" * 64 + bytes(64) + bytes(range(256)) * 40
    wanted = media.encode(payload)
    monkeypatch.setattr(media, "PIECE", 16)
    assert media.encode(payload) == wanted
    assert media.payload_of(*media.read_files([wanted])[0]) == payload


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
def test_files_of_other_writers(factors, restart, several):
    rng = random.Random(restart)
    files = [slow_encode(w, h, factors, OTHER_TABLES, restart, rng, several) for w, h in ((50, 37), (8, 8), (17, 90))]
    images = [media.parse(f) for f, _ in files]
    for (raw, grids), image, found in zip(files, images, media.coefficients_of(images), strict=True):
        for c, grid, got in zip(image.components, grids, found, strict=True):
            assert got.tolist() == [grid[y, x] for y in range(c.high) for x in range(c.wide)]
        if not several:
            slow = slow_decode(raw)[0]
            assert all(slow[j] == grids[j] for j in range(len(factors)))


def test_luminance_thumbnail_of_a_colour_file(spark):
    raw, grids = slow_encode(72, 64, [(1, 1)] * 3, OTHER_TABLES, 2, random.Random(5))
    image, blocks = media.read_files([raw])[0]
    thumb = media.thumbnail(image, blocks)
    assert thumb == pytest.approx(np.array([[np.clip(grids[0][y, x][0] * 2 / 8 + 128, 0, 255) for x in range(9)] for y in range(8)]))


def test_broken_files_are_rows_with_a_reason(spark):
    good = media.encode(b"abc" * 64)
    scan = good.index(b"\xff\xda")
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    broken = [None, b"", b"GIF89a", good[:40], good[: scan + 14], good[: len(good) - 9], progressive, good[:scan] + b"\xff\xd9", good.replace(b"\xff\xc4", b"\xff\xe4"), good.replace(b"\xff\xdb", b"\xff\xe4")]
    df = spark.createDataFrame([(k, b, "x") for k, b in enumerate([good, *broken, good])], "k int, media binary, feature string")
    rows = {r.k: r for r in media.describe(df, "media", ("k",)).collect()}
    assert rows[0].error is None and rows[0].feature == rows[len(broken) + 1].feature and rows[0].width == 24
    for k in range(1, len(broken) + 1):
        assert rows[k].error and rows[k].feature is None and rows[k].width is None, k
    assert media.describe(df.limit(0), "media", ("k",)).count() == 0


def test_random_damage_never_raises():
    good, rng = media.encode(words(300, 2).encode()[: 64 * 20]), random.Random(11)
    damaged = []
    for _ in range(200):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(2, len(raw))] = rng.randrange(256)
        damaged.append(bytes(raw[: rng.randrange(10, len(raw) + 1)]))
    assert len(media.read_files(damaged)) == 200


def test_texts_as_media(spark, docs, none):  # noqa: F811
    rows = media.store_texts(docs).collect()
    wanted = collections.Counter()
    for _, t in odd_texts():
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        wanted[len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert collections.Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == wanted
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in rows)
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}) == 1
    assert media.store_texts(none).count() == 0
