"""Operator 9: binary media columns as baseline JPEG.

Reading: the markers are parsed, byte stuffing is undone, the scan is split at its restart markers, and all restart
segments of a batch of files are Huffman-decoded side by side: each numpy step takes the next symbol of every
segment, so a file without restart markers is one segment and read symbol by symbol.  Images of one or several components,
interleaved or not, are read.  ``thumbnail`` needs only the DC coefficients of the first component: each gives the
mean luminance of a block of 8 by 8 samples, so no inverse transform is run.

Writing: bytes are stored without loss as quantised coefficients, the format's own unit: byte b is the signed value b or
b-256.  A block holds 64 bytes in the order of the scan; DC values are coded as differences, zeros as runs, the rest
of a block as its end, with canonical Huffman tables made from fixed weights.  A restart marker stands behind
each ``RESTART`` blocks.

Cases: null and empty texts are stored as one block of zero bytes.  Texts of any length up to 8191 by 8191 blocks are
stored whole: the image has ``ROW`` blocks in a row, more where that would be higher than the format allows, zero
blocks fill its last row, and a comment gives the number of payload bytes.  Encoding and decoding take ``PIECE`` blocks
at a time.  Repeated rows and equal texts give equal files; an empty table gives an empty one; other columns than those
asked for are passed by.  A file that can't be read gives a row with nulls and the reason in ``error``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm.common import map_texts, table, text_column

#: Blocks in a row of the image.
ROW = 64
#: Largest number of blocks in a row or column, a limit of the format.
SIDE = 8191
#: Blocks between restart markers.
RESTART = 4
#: Blocks that are encoded or decoded together.
PIECE = 8192
#: Payload bytes of texts that are worked on together.
GROUP_BYTES = 1 << 19
#: Quantisation step of the DC coefficient: DC values of +-128 become means of +-128 around grey.
DC_STEP = 8
#: Huffman tables that files of one decoding step may have in all; each takes a lookup table of 256 KB.
TABLES = 16


# --- Huffman tables ----------------------------------------------------------------------------


def huffman_table(weights: dict[int, int]) -> tuple[bytes, bytes]:
    """A table in the format's form (number of codes of each length, symbols by length) with short codes for heavy symbols.

    A symbol lighter than all others is added and left out again, as no code may be all ones.
    """
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0, -1, (-1,))]
    heapq.heapify(heap)
    length, at = dict.fromkeys([*weights, -1], 0), len(heap)
    while len(heap) > 1:
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (wa + wb, at, a + b))
        at += 1
    if max(length.values()) > 16:
        raise ValueError("the weights ask for codes of more than 16 bits")
    symbols = sorted(weights, key=lambda s: (length[s], s))
    return bytes(sum(length[s] == n for s in weights) for n in range(1, 17)), bytes(symbols)


def canonical(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (length, code): codes of a length follow each other, a longer one continues the next free prefix."""
    found, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[k : k + count]:
            found[s] = (n, code)
            code += 1
        if code > 1 << n:
            raise ValueError("a Huffman table with more codes than fit")
        k, code = k + count, code << 1
    return found


@functools.lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length * 256 + symbol of the code that they begin with; 0 where none does."""
    out = np.zeros(1 << 16, np.int32)
    for s, (n, code) in canonical(counts, symbols).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


#: The writer's tables: a symbol's weight triples with each bit of its values up to 7, as letters have 7, and is a
#: sixteenth with each zero before it.
_SIZE_WEIGHT = {s: 3 ** (s if s <= 7 else 3) for s in range(9)}
DC_TABLE = huffman_table({s: _SIZE_WEIGHT[s] for s in range(9)})
AC_TABLE = huffman_table({0x00: 27, 0xF0: 1} | {run << 4 | s: max(1, _SIZE_WEIGHT[s] >> 4 * run) for run in range(16) for s in range(1, 9)})


def _code_arrays(spec: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths, codes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (n, code) in canonical(*spec).items():
        lengths[s], codes[s] = n, code
    return lengths, codes


_DC_CODES, _AC_CODES = _code_arrays(DC_TABLE), _code_arrays(AC_TABLE)
#: Number of bits of the magnitude of each value from -255 to 255.
_BITS = np.array([abs(v).bit_length() for v in range(-255, 256)])


# --- writing -----------------------------------------------------------------------------------


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _scan_piece(blocks: np.ndarray, first_marker: int) -> bytes:
    """Entropy-coded segments of whole restart intervals, each followed by its marker."""
    n = len(blocks)
    values = blocks.astype(np.int64)
    dc = values[:, 0].copy()
    inner = np.arange(n) % RESTART > 0
    dc[inner] -= values[np.flatnonzero(inner) - 1, 0]
    # symbols in the order of the scan: DC difference, then non-zero values with the zeros before them, then end of block
    row, k = np.nonzero(values[:, 1:])
    k = k + 1
    before = np.zeros(len(k), np.int64)
    same = row[1:] == row[:-1]
    before[1:][same] = k[:-1][same]
    run = k - before - 1
    last = np.zeros(n, np.int64)
    np.maximum.at(last, row, k)
    some = _BITS[values[row, k] + 255]
    long_runs = np.repeat(np.arange(len(k)), run >> 4)
    open_end = np.flatnonzero(last < 63)
    place = np.concatenate([np.arange(n) * 128, row * 128 + 2 * k, row[long_runs] * 128 + 2 * k[long_runs] - 1, open_end * 128 + 127])
    dc_bits = _BITS[dc + 255]
    symbol = np.concatenate([dc_bits, (run & 15) << 4 | some, np.full(len(long_runs), 0xF0), np.zeros(len(open_end), np.int64)])
    of_dc = np.zeros(len(place), bool)
    of_dc[:n] = True
    extra = np.concatenate([dc_bits, some, np.zeros(len(long_runs) + len(open_end), np.int64)])
    value = np.concatenate([dc, values[row, k], np.zeros(len(long_runs) + len(open_end), np.int64)])
    value = np.where(value < 0, value + (1 << extra) - 1, value)
    code = np.where(of_dc, _DC_CODES[1][symbol], _AC_CODES[1][symbol]) << extra | value
    length = np.where(of_dc, _DC_CODES[0][symbol], _AC_CODES[0][symbol]) + extra
    order = np.argsort(place, kind="stable")
    place, code, length = place[order], code[order], length[order]
    # each segment is filled up with ones to a whole byte
    segment = place // (128 * RESTART)
    ends = np.cumsum(length)
    closing = np.searchsorted(segment, np.arange(segment[-1] + 1), side="right") - 1
    used = np.diff(ends[closing], prepend=0)
    pad = -used % 8
    shift = np.cumsum(pad) - pad
    start = ends - length + shift[segment]
    start = np.concatenate([start, ends[closing] + shift])
    code, length = np.concatenate([code, (1 << pad) - 1]), np.concatenate([length, pad])
    # codes have at most 24 bits, so that each lies within four bytes; bits don't overlap, so that sums are unions
    window, at = code << (32 - (start & 7) - length), start >> 3
    raw = np.zeros(int(start[-1] + length[-1]) // 8 + 4, np.int64)
    for j in range(4):
        raw += np.bincount(at + j, (window >> (24 - 8 * j)) & 255, len(raw)).astype(np.int64)
    raw = raw[:-4].astype(np.uint8)
    # a zero behind each 0xFF, and the markers
    stops = np.cumsum((used + pad) // 8)
    marks = np.array([[0xFF, 0xD0 + (first_marker + j) % 8] for j in range(len(stops))], np.uint8).reshape(-1)
    full = np.flatnonzero(raw == 0xFF) + 1
    put = np.concatenate([full, np.repeat(stops, 2)])
    what = np.concatenate([np.zeros(len(full), np.uint8), marks])
    return np.insert(raw, put, what).tobytes()


def encode(payload: bytes) -> bytes:
    """A baseline JPEG that holds ``payload``, whose length is a positive multiple of 64, in its coefficients."""
    n = len(payload) // 64
    high = min(-(-n // ROW), SIDE)
    wide = -(-n // high)
    if wide > SIDE:
        raise ValueError("payload is larger than an image can be")
    values = np.zeros((wide * high, 64), np.int8)
    values.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.int8)
    pieces = [_scan_piece(values[at : at + PIECE], at // RESTART) for at in range(0, len(values), PIECE)]
    pieces[-1] = pieces[-1][:-2]  # no marker behind the last segment
    head = [
        b"\xff\xd8", _marker(0xFE, b"payload %d" % len(payload)), _marker(0xDB, bytes([0, DC_STEP] + [1] * 63)),
        _marker(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + bytes([1, 0x11, 0])),
        *(_marker(0xC4, bytes([kind]) + counts + symbols) for kind, (counts, symbols) in ((0x00, DC_TABLE), (0x10, AC_TABLE))),
        _marker(0xDD, struct.pack(">H", RESTART)), _marker(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
    return b"".join([*head, *pieces, b"\xff\xd9"])


# --- reading -----------------------------------------------------------------------------------


@dataclass
class Component:
    """A component of a frame: sampling factors, quantisation table, size in blocks."""

    name: int
    across: int
    down: int
    quant: int
    wide: int = 0
    high: int = 0


@dataclass
class Scan:
    """A scan: (component's place in the frame, DC table, AC table) of each part, and its bytes."""

    parts: list[tuple[int, tuple[bytes, bytes], tuple[bytes, bytes]]]
    restart: int
    data: bytes


@dataclass
class Image:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    mcus: tuple[int, int] = (0, 0)


def _frame(image: Image, body: bytes) -> None:
    bits, image.height, image.width, parts = struct.unpack_from(">BHHB", body)
    if bits != 8 or not image.height or not image.width or not 1 <= parts <= 4:
        raise ValueError("not a frame of 8-bit samples with known dimensions")
    for k in range(parts):
        name, factors, quant = body[6 + 3 * k : 9 + 3 * k]
        if not (1 <= factors >> 4 <= 4 and 1 <= factors & 15 <= 4):
            raise ValueError("a sampling factor out of range")
        image.components.append(Component(name, factors >> 4, factors & 15, quant))
    if parts == 1:  # a single component is never interleaved
        image.components[0].across = image.components[0].down = 1
    most_across, most_down = max(c.across for c in image.components), max(c.down for c in image.components)
    image.mcus = (-(-image.width // (8 * most_across)), -(-image.height // (8 * most_down)))
    for c in image.components:
        c.wide, c.high = -(-(-(-image.width * c.across // most_across)) // 8), -(-(-(-image.height * c.down // most_down)) // 8)


def parse(jpeg: bytes) -> Image:
    """Dimensions, tables, comment and scans of a baseline JPEG; ValueError if it is none."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        if at + 2 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        code = jpeg[at + 1]
        if code == 0xFF:  # a fill byte
            at += 1
            continue
        if code == 0xD9:
            break
        if at + 4 > len(jpeg):
            raise ValueError("the file ends within a marker")
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if size < 2 or at > len(jpeg):
            raise ValueError("the file ends within a marker")
        if code == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                if len(body) < 1 + 64 * wide:
                    raise ValueError("a quantisation table is cut")
                image.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(int)
                body = body[1 + 64 * wide :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a Huffman table is cut")
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif code == 0xC0:
            if image.components or len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise ValueError("a second or a cut frame")
            _frame(image, body)
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            image.comment = body
        elif code == 0xDA:
            places = {c.name: k for k, c in enumerate(image.components)}
            try:
                parts = [(places[body[1 + 2 * j]], tables[body[2 + 2 * j] >> 4], tables[0x10 | body[2 + 2 * j] & 15]) for j in range(body[0])]
            except (KeyError, IndexError):
                raise ValueError("a scan names what the file doesn't have") from None
            raw = np.frombuffer(jpeg, np.uint8, offset=at)
            ff = np.flatnonzero(raw[:-1] == 0xFF)
            after = raw[ff + 1]
            stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            end = at + int(stop[0]) if len(stop) else len(jpeg)
            image.scans.append(Scan(parts, restart, jpeg[at:end]))
            at = end
            if at == len(jpeg):  # the end marker is missing
                break
        elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
    if not image.scans:
        raise ValueError("no scan")
    return image


def _segments(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a scan without stuffing and markers, and where each restart segment ends."""
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[ff + 1] if len(ff) else raw[:0]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks] = False
    keep[marks + 1] = False
    return raw[keep], (np.cumsum(keep) - keep)[marks].tolist() + [int(keep.sum())]


@dataclass
class _Work:
    """Restart segments of one scan, ready for decoding: bytes, segment ends, blocks of each segment, component of
    each block of an MCU, tables of each of these components, and where decoded blocks go."""

    image: int
    raw: np.ndarray
    ends: list[int]
    blocks: list[int]
    pattern: list[int]
    specs: list[tuple[tuple[bytes, bytes], tuple[bytes, bytes]]]
    targets: list[tuple[int, np.ndarray]]


def _work(number: int, image: Image, scan: Scan) -> _Work:
    """The segments of a scan, and for each component the place in its block grid of each block that the scan holds."""
    raw, ends = _segments(scan.data)
    pattern, targets = [], []
    if len(scan.parts) == 1:
        c = image.components[scan.parts[0][0]]
        units, pattern = c.wide * c.high, [0]
        targets.append((scan.parts[0][0], np.arange(units)))
    else:
        units = image.mcus[0] * image.mcus[1]
        for j, (k, _, _) in enumerate(scan.parts):
            c = image.components[k]
            pattern += [j] * (c.across * c.down)
            y, x = np.divmod(np.arange(units), image.mcus[0])
            inner = np.arange(c.across * c.down)
            rows, columns = y[:, None] * c.down + inner // c.across, x[:, None] * c.across + inner % c.across
            inside = (rows < c.high) & (columns < c.wide)  # the rest only fills up the last units
            targets.append((k, np.where(inside, rows * c.wide + columns, -1).reshape(-1)))
    step = scan.restart or units
    counts = [min(step, units - at) * len(pattern) for at in range(0, units, step)]
    if len(ends) != len(counts):
        raise ValueError(f"{len(counts)} restart segments are due, {len(ends)} are there")
    return _Work(number, raw, ends, counts, pattern, [(dc, ac) for _, dc, ac in scan.parts], targets)


_MASK = np.int64((1 << 40) - 1)


def decode_segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, shape: np.ndarray, tables: np.ndarray, luts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman-decode many segments side by side: coefficients of all blocks in order, and per segment whether it failed.

    ``patterns[shape, b]`` is the component of an MCU's b-th block of ``sizes[shape]``, ``tables[shape, component]`` its
    DC and AC tables among ``luts``, flattened lookups of 65536 entries.
    """
    at = np.concatenate([raw, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    window = at[:-4] << 32 | at[1:-3] << 24 | at[2:-2] << 16 | at[3:-1] << 8 | at[4:]
    first = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), 64), np.int16)
    flat, failed = out.reshape(-1), np.zeros(len(counts), bool)
    who = np.flatnonzero(counts)
    pos, limit, block, left, kind = starts[who] * 8, ends[who] * 8, first[who] * 64, counts[who], shape[who]
    unit, k = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    guess = np.zeros((len(who), tables.shape[1]), np.int64)
    lanes = np.arange(len(who))
    while len(who):
        part = patterns[kind, unit]
        dc = k == 0
        bits = (window[pos >> 3] << (pos & 7)) & _MASK
        entry = luts[tables[kind, part, 1 - dc] * 65536 + (bits >> 24)]
        length, symbol = entry >> 8, entry & 255
        size = symbol & 15
        value = ((bits << length) & _MASK) >> (40 - size)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        pos = pos + length + size
        k = np.where(dc, 0, k + (symbol >> 4))
        bad = (entry == 0) | (pos > limit) | (k > 63) | (dc & (symbol > 11))
        guess[lanes[dc], part[dc]] += value[dc]
        put = np.flatnonzero((dc | (size > 0)) & ~bad)
        flat[block[put] + k[put]] = np.where(dc[put], guess[lanes[put], part[put]], value[put])
        k = np.where(~dc & (symbol == 0), 64, k + 1)
        done = k > 63
        k[done] = 0
        block = block + 64 * done
        left = left - done
        unit = np.where(done, (unit + 1) % sizes[kind], unit)
        over = bad | (left == 0)
        if over.any():
            failed[who[bad]] = True
            stay = ~over
            who, pos, limit, block, left, kind, unit, k, guess = (x[stay] for x in (who, pos, limit, block, left, kind, unit, k, guess))
            lanes = np.arange(len(who))
    return out, failed


def coefficients_of(images: list[Image]) -> list[list[np.ndarray] | ValueError]:
    """Per image the quantised coefficients of each component's blocks (in the order of the scan, DC values absolute),
    or what is wrong with it."""
    found: list[list[np.ndarray] | ValueError] = []
    jobs = []
    for number, image in enumerate(images):
        try:
            # a block takes two bits at least: what promises more is damaged, and no memory is given to it
            if sum(c.wide * c.high for c in image.components) > 4 * sum(len(scan.data) for scan in image.scans):
                raise ValueError("the scan is too short for the image's dimensions")
            found.append([np.zeros((c.wide * c.high, 64), np.int16) for c in image.components])
            jobs += [_work(number, image, scan) for scan in image.scans]
            for scan in image.scans:
                for _, dc, ac in scan.parts:
                    canonical(*dc), canonical(*ac)
        except ValueError as e:
            found[number:] = [e]
    jobs = [j for j in jobs if not isinstance(found[j.image], ValueError)]
    at = 0
    while at < len(jobs):
        group, known, blocks = [], {}, 0
        while at < len(jobs):
            new = dict.fromkeys(t for pair in jobs[at].specs for t in pair)
            if group and (len(known | new) > TABLES or blocks + sum(jobs[at].blocks) > PIECE):
                break
            known |= new
            blocks += sum(jobs[at].blocks)
            group.append(jobs[at])
            at += 1
        _decode_group(group, known, found)
    return found


def _decode_group(group: list[_Work], known: dict, found: list) -> None:
    """Decode the segments of some scans together, a bounded number of blocks at a time."""
    number = {t: n for n, t in enumerate(known)}
    luts = np.concatenate([lookup(*t) for t in known])
    shapes = list(dict.fromkeys((tuple(j.pattern), tuple(j.specs)) for j in group))
    sizes = np.array([len(p) for p, _ in shapes])
    patterns = np.array([[*p, *[0] * (max(sizes) - len(p))] for p, _ in shapes])
    parts = max(len(s) for _, s in shapes)
    tables = np.array([[[number[dc], number[ac]] for dc, ac in s] + [[0, 0]] * (parts - len(s)) for _, s in shapes])
    base = np.cumsum([0, *(len(j.raw) for j in group)])
    starts = np.concatenate([b + np.array([0, *j.ends[:-1]]) for b, j in zip(base, group, strict=False)])
    ends = np.concatenate([b + np.array(j.ends) for b, j in zip(base, group, strict=False)])
    counts = np.concatenate([j.blocks for j in group]).astype(np.int64)
    owner = np.repeat(np.arange(len(group)), [len(j.blocks) for j in group])
    shape = np.array([shapes.index((tuple(j.pattern), tuple(j.specs))) for j in group])[owner]
    raw, out, failed, lo, total = np.concatenate([j.raw for j in group]), [], [], 0, np.cumsum(counts)
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - counts[lo] + PIECE, side="right")))
        own = slice(lo, hi)
        a, b = starts[lo], ends[hi - 1]
        blocks, bad = decode_segments(raw[a:b], starts[own] - a, ends[own] - a, counts[own], patterns, sizes, shape[own], tables, luts)
        out.append(blocks)
        failed.append(bad)
        lo = hi
    blocks, failed, at = np.concatenate(out), np.concatenate(failed), 0
    for k, j in enumerate(group):
        own = blocks[at : at + sum(j.blocks)]
        at += len(own)
        if failed[owner == k].any():
            found[j.image] = ValueError("the scan ends early or holds a code that the table doesn't have")
        if isinstance(found[j.image], ValueError):
            continue
        pattern = np.tile(j.pattern, len(own) // len(j.pattern))
        for part, (component, places) in enumerate(j.targets):
            inside = places >= 0
            found[j.image][component][places[inside]] = own[pattern == part][inside]


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored; ValueError if the file doesn't say how many."""
    word, _, size = image.comment.partition(b" ")
    if word != b"payload" or not size.isdigit() or int(size) > coefficients.size:
        raise ValueError("no payload of ours")
    return coefficients.reshape(-1)[: int(size)].astype(np.int8).tobytes()


def thumbnail(image: Image, coefficients: np.ndarray, wide: int = 9, high: int = 8) -> np.ndarray:
    """A luminance picture of ``wide`` by ``high`` from the first component's DC coefficients alone: means over the blocks of each cell."""
    c = image.components[0]
    step = int(image.quant[c.quant][0])
    grey = np.clip(coefficients[:, 0].astype(float) * step / 8 + 128, 0, 255).reshape(c.high, c.wide)
    sums = np.zeros((c.high + 1, c.wide + 1))
    np.cumsum(np.cumsum(grey, 0), 1, out=sums[1:, 1:])
    y0, x0 = np.arange(high) * c.high // high, np.arange(wide) * c.wide // wide
    y1, x1 = np.maximum((np.arange(high) + 1) * c.high // high, y0 + 1), np.maximum((np.arange(wide) + 1) * c.wide // wide, x0 + 1)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return total / np.outer(y1 - y0, x1 - x0)


def feature(image: Image, coefficients: np.ndarray) -> str:
    """Dimensions and a hash of the thumbnail: whether each cell is darker than its right neighbour."""
    thumb = thumbnail(image, coefficients)
    bits = (thumb[:, :-1] < thumb[:, 1:]).reshape(-1)
    return f"{image.width}x{image.height}:{np.packbits(bits).tobytes().hex()}"


def read_files(files: list[bytes | None]) -> list[tuple[Image, np.ndarray] | ValueError]:
    """Per file what its markers say and the coefficients of its first component, or why it can't be read."""
    parsed: list[Image | ValueError] = []
    for raw in files:
        try:
            image = parse(raw or b"")
            if image.components[0].quant not in image.quant:
                raise ValueError("no quantisation table")
            parsed.append(image)
        except (ValueError, struct.error, IndexError) as e:
            parsed.append(ValueError(str(e)))
    good = [k for k, x in enumerate(parsed) if isinstance(x, Image)]
    out: list = list(parsed)
    for k, blocks in zip(good, coefficients_of([parsed[k] for k in good]), strict=True):
        out[k] = blocks if isinstance(blocks, ValueError) else (parsed[k], blocks[0])
    return out


def describe(media: DataFrame, column: str, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each row, and width, height, feature and error of the JPEG in ``column``: all null but error where it can't be read."""
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in columns), "width int, height int, feature string, error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for found in read_files(part.column(len(columns)).to_pylist()):
                    rows.append((None, None, None, str(found)) if isinstance(found, ValueError) else (found[0].width, found[0].height, feature(*found), None))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*columns, "width", "height", "feature", "error"])

    return map_texts(media.select(*columns, column), run, schema)


def _groups(texts: list[str]) -> Iterator[list[bytes]]:
    """The texts' bytes, some ``GROUP_BYTES`` at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def store_texts(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Each text stored as a JPEG, read back and described.

    Result: the id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of what was read back, media (the file),
    width, height, media_sha256 and feature.  Null texts count as empty.
    """
    kept = docs.select(id_column, column)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, feature string, media binary"
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "media"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raws in _groups(text_column(batch.column(1)).to_pylist()):
                files, rows = [encode(raw + bytes(-len(raw) % 64 if raw else 64)) for raw in raws], []
                for raw, media, found in zip(raws, files, read_files(files), strict=True):
                    if isinstance(found, ValueError):
                        raise found
                    back = payload_of(*found)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), found[0].width, found[0].height, feature(*found), media))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)
                at += len(rows)

    return map_texts(kept, run, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as a media column; the files themselves are not returned here."""
    return store_texts(table(spark, sf_dir, "documents")).drop("media")
