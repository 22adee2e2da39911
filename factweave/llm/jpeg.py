"""Progressive JPEG: coefficients to bytes and back, and to pixels, on arrays of whole batches.

A reader accumulates the scans of spectral selection and successive
approximation in coefficient arrays. Restart intervals are independent, so all
intervals of all images of a batch are decoded side by side: one symbol of each
per step. Images without restart markers decode too, with one lane each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: the order in which a block's 64 coefficients are stored.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
SOI, SOF2, DHT, RST0, EOI, SOS, DQT, DRI = 0xD8, 0xC2, 0xC4, 0xD0, 0xD9, 0xDA, 0xDB, 0xDD
EOB, ZRL = 0x00, 0xF0


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks that the image needs
    down: int = 0
    wide: int = 0  # blocks with those that fill the last MCU
    high: int = 0
    first: int = 0  # the first block's row in the coefficient array


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[int, int]]
    start: int
    end: int
    high: int
    low: int
    restart: int
    data: bytes
    dc: dict
    ac: dict


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    blocks: int = 0

    def lay_out(self) -> None:
        """Sizes in blocks of the components, as the sampling factors give them."""
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        mcus_x, mcus_y = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        self.mcus = mcus_x * mcus_y
        self.mcus_x = mcus_x
        for c in self.components:
            c.across = -(-(-(-self.width * c.h // hmax)) // 8)
            c.down = -(-(-(-self.height * c.v // vmax)) // 8)
            c.wide, c.high, c.first = mcus_x * c.h, mcus_y * c.v, self.blocks
            self.blocks += c.wide * c.high

    def scan_order(self, which: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """The blocks of a scan in their order: row in the coefficient array, component's place in the scan, blocks of an MCU."""
        return block_order(self.mcus, self.mcus_x, tuple((c.h, c.v, c.across, c.down, c.wide, c.first) for c in (self.components[i] for i in which)))


@lru_cache(maxsize=512)
def block_order(mcus: int, mcus_x: int, components: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """components: (h, v, across, down, wide, first) of those in a scan. The arrays are shared and not written to."""
    if len(components) == 1:
        _, _, across, down, wide, first = components[0]
        rows = first + np.arange(down)[:, None] * wide + np.arange(across)
        return rows.ravel(), np.zeros(rows.size, np.int64), 1
    parts, places = [], []
    y, x = np.divmod(np.arange(mcus), mcus_x)
    for place, (across_mcu, down_mcu, _, _, wide, first) in enumerate(components):
        for v in range(down_mcu):
            for h in range(across_mcu):
                parts.append(first + (y * down_mcu + v) * wide + x * across_mcu + h)
                places.append(place)
    rows = np.stack(parts, axis=1)
    return rows.ravel(), np.tile(places, mcus), rows.shape[1]


# ---------------------------------------------------------------- Huffman tables


def code_table(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths by symbol."""
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, at = 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            codes[s], lengths[s] = code, length
            code += 1
        at += n
        code <<= 1
    return codes, lengths


def lookup_table(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For the next 16 bits the symbol and the code's length: symbol * 32 + length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    codes, lengths = code_table(counts, symbols)
    for s in symbols[: sum(counts)]:
        span = 16 - lengths[s]
        table[codes[s] << span : (codes[s] + 1) << span] = s * 32 + lengths[s]
    return table


def own_tables() -> tuple[list[int], list[int]]:
    """One table for all scans: short codes for a coefficient without zeros before it, and for the end of a block."""
    short = [EOB, *range(1, 11)]
    others = [s for s in range(256) if s not in short]
    counts = [0] * 16
    counts[3], counts[11] = len(short), len(others)
    return counts, short + others


# ---------------------------------------------------------------- writing


def bit_size(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def extra_bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits that follow a size: the value, or for negative ones its complement."""
    return np.where(values < 0, values + (1 << sizes) - 1, values)


def pack(codes: np.ndarray, lengths: np.ndarray, lane_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes codes (at most 32 bits each) one after another, each lane from a byte's start, filled with ones.

    lane_ends: how many codes there are up to each lane's end. Gives bytes and each lane's end in them.
    """
    upto = np.concatenate(([0], np.cumsum(lengths)))
    lane_bits = np.diff(upto[np.concatenate(([0], lane_ends))])
    lane_bytes = -(-lane_bits // 8)
    byte_ends = np.cumsum(lane_bytes)
    # Each lane ends with a code of ones up to the byte's end.
    fill = lane_bytes * 8 - lane_bits
    codes = np.insert(codes, lane_ends, (1 << fill) - 1)
    lengths = np.insert(lengths, lane_ends, fill)
    starts = np.cumsum(lengths) - lengths
    words = np.zeros(int(byte_ends[-1] if byte_ends.size else 0) // 4 + 3, np.uint64)
    used = lengths > 0
    codes, lengths, starts = codes[used].astype(np.uint64), lengths[used], starts[used]
    if codes.size:
        word, shift = starts >> 5, (64 - (starts & 31) - lengths).astype(np.uint64)
        both = codes << shift
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        joined = np.bitwise_or.reduceat(both, first)
        at = word[first]
        words[at] |= joined >> np.uint64(32)
        words[at + 1] |= joined & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").view(np.uint8)[: int(byte_ends[-1]) if byte_ends.size else 0], byte_ends


def entropy_coded(data: np.ndarray, ends: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Each image's scan: a zero byte after each 0xFF, and restart markers between its lanes.

    lanes: how many lanes each image has.
    """
    last = np.zeros(ends.size, bool)
    last[np.cumsum(lanes) - 1] = True
    nth = np.arange(ends.size) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    full = np.flatnonzero(data == 0xFF)
    marks = ends[~last]
    where = np.concatenate((full + 1, marks, marks))
    what = np.concatenate((np.zeros(full.size, np.uint8), np.full(marks.size, 0xFF, np.uint8), (RST0 + nth[~last] % 8).astype(np.uint8)))
    order = np.argsort(where, kind="stable")
    raw = np.insert(data, where[order], what[order]).tobytes()
    image_ends = ends[last]
    image_ends = image_ends + np.searchsorted(full, image_ends) + 2 * (np.cumsum(~last)[last])
    starts = np.concatenate(([0], image_ends[:-1]))
    return [raw[x:y] for x, y in zip(starts.tolist(), image_ends.tolist())]


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def dc_first(values: np.ndarray, places: np.ndarray, lane: int, low: int, codes, lengths) -> tuple[np.ndarray, np.ndarray]:
    """values: DC of the blocks in scan order, ``lane`` blocks to a restart interval. Codes with their extra bits."""
    shifted = values >> low
    before = np.zeros_like(shifted)
    for place in np.unique(places):
        own = np.flatnonzero(places == place)
        prev = np.concatenate(([0], shifted[own][:-1]))
        prev[np.concatenate(([True], own[1:] // lane != own[:-1] // lane))] = 0
        before[own] = prev
    diff = shifted - before
    sizes = bit_size(diff)
    return codes[sizes] << sizes | extra_bits(diff, sizes), lengths[sizes] + sizes


def ac_first(block: np.ndarray, low: int, codes, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block: one band's coefficients, a row for each block. Codes, lengths, and codes of each block.

    Each coefficient that isn't zero takes its place in a fixed grid of codes:
    up to three long runs of zeros before it, its own code, and the block's end.
    """
    values = np.sign(block) * (np.abs(block) >> low)
    n, width = values.shape
    rows, cols = np.nonzero(values)
    last = np.full(n, -1)
    last[rows] = cols  # the last one counts
    prev = np.concatenate(([-1], cols[:-1]))
    prev[np.concatenate(([True], rows[1:] != rows[:-1]))[: prev.size]] = -1
    run = cols - prev - 1 if cols.size else cols
    v = values[rows, cols]
    sizes = bit_size(v)
    symbol = (run & 15) << 4 | sizes
    own_code = codes[symbol] << sizes | extra_bits(v, sizes)
    own_length = lengths[symbol] + sizes
    # Order: by block and column, long runs before their coefficient, the end of the block last.
    long_runs = run >> 4
    items = np.repeat(np.arange(rows.size), long_runs + 1)
    is_own = np.zeros(items.size, bool)
    is_own[np.cumsum(long_runs + 1) - 1] = True
    code = np.where(is_own, own_code[items], codes[ZRL])
    length = np.where(is_own, own_length[items], lengths[ZRL])
    each = np.bincount(rows[items], minlength=n)
    ends = np.cumsum(each)
    short = last < width - 1
    code = np.insert(code, ends[short], codes[EOB])
    length = np.insert(length, ends[short], lengths[EOB])
    return code, length, each + short


def ac_refine(block: np.ndarray, low: int, codes, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next lower bit of one band: a correction bit for each coefficient that is known not to be zero, and new ones.

    New coefficients are +1 or -1 at this bit. A code is a symbol with the
    correction bits that belong to it; these are written as codes of one bit.
    """
    mag = np.abs(block) >> low
    known, new = mag > 1, mag == 1
    n, width = block.shape
    # Zeros that stay zero, counted since the last new coefficient, are the run of the next one.
    still = ~known & ~new
    code_rows: list[np.ndarray] = []
    out_c, out_l, each = [], [], np.zeros(n, np.int64)
    plain = ~new.any(axis=1)
    for r in range(n) if not plain.all() else ():
        if plain[r]:
            continue
        c, ln, pending, run = [], [], [], 0
        lastnew = np.flatnonzero(new[r])[-1]
        for k in range(width):
            if known[r, k]:
                pending.append(int(mag[r, k]) & 1)
            elif still[r, k] and k < lastnew:
                run += 1
                if run == 16:
                    # The run's last zero ends the symbol; corrections before it belong to it.
                    c += [int(codes[ZRL]), *pending]
                    ln += [int(lengths[ZRL]), *[1] * len(pending)]
                    pending, run = [], 0
            elif new[r, k]:
                s = run << 4 | 1
                c += [int(codes[s]) << 1 | int(block[r, k] > 0), *pending]
                ln += [int(lengths[s]) + 1, *[1] * len(pending)]
                pending, run = [], 0
        if lastnew < width - 1:
            c += [int(codes[EOB]), *pending]
            ln += [int(lengths[EOB]), *[1] * len(pending)]
        code_rows.append((r, np.array(c, np.int64), np.array(ln, np.int64)))
    # Blocks without new coefficients: the end of the block, then all corrections, up to 31 in one code.
    grid_c = np.zeros((n, 1 + -(-width // 31)), np.int64)
    grid_l = np.zeros_like(grid_c)
    grid_c[:, 0], grid_l[:, 0] = codes[EOB], lengths[EOB]
    order = np.cumsum(known, axis=1) - 1
    rows, cols = np.nonzero(known)
    slot = 1 + order[rows, cols] // 31
    total = known.sum(axis=1)
    for s in range(1, grid_c.shape[1]):
        grid_l[:, s] = np.clip(total - 31 * (s - 1), 0, 31)
    place = np.clip(grid_l[rows, slot] - 1 - order[rows, cols] % 31, 0, 31)
    np.add.at(grid_c, (rows, slot), (mag[rows, cols] & 1) << place)
    if not code_rows:
        return grid_c.ravel(), grid_l.ravel(), np.full(n, grid_c.shape[1])
    special = {r: (c, ln) for r, c, ln in code_rows}
    for r in range(n):
        c, ln = special.get(r, (grid_c[r], grid_l[r]))
        out_c.append(c)
        out_l.append(ln)
        each[r] = c.size
    return np.concatenate(out_c), np.concatenate(out_l), each


def by_block(block: np.ndarray, high: int, low: int, codes, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One band's codes, lengths, and codes of each block.

    Blocks in which every coefficient has its code at this bit, or had it
    before, have one pattern of codes, which is laid out as a grid; the others
    go through the general forms.
    """
    n, width = block.shape
    full = (np.abs(block) >> (low + 1 if high else low)).all(axis=1)
    some = np.flatnonzero(full)
    own = block[some]
    if high:
        parts = -(-width // 31)
        bits = np.abs(own) >> low & 1
        grid_c, grid_l = np.empty((some.size, 1 + parts), np.int64), np.empty((some.size, 1 + parts), np.int64)
        grid_c[:, 0], grid_l[:, 0] = codes[EOB], lengths[EOB]
        for i in range(parts):
            piece = bits[:, 31 * i : 31 * i + 31]
            wide = piece.shape[1]
            grid_c[:, 1 + i], grid_l[:, 1 + i] = (piece.astype(np.float64) @ (2.0 ** np.arange(wide - 1, -1, -1))).astype(np.int64), wide
    else:
        values = np.sign(own) * (np.abs(own) >> low)
        sizes = bit_size(values)
        grid_c, grid_l = codes[sizes] << sizes | extra_bits(values, sizes), lengths[sizes] + sizes
    if some.size == n:
        return grid_c.ravel(), grid_l.ravel(), np.full(n, grid_c.shape[1])
    rest = np.flatnonzero(~full)
    c, ln, each_rest = (ac_refine if high else ac_first)(block[rest], low, codes, lengths)
    each = np.empty(n, np.int64)
    each[some], each[rest] = grid_c.shape[1], each_rest
    starts = np.cumsum(each) - each
    out_c, out_l = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
    if some.size:
        at = starts[some][:, None] + np.arange(grid_c.shape[1])
        out_c[at], out_l[at] = grid_c, grid_l
    at = np.repeat(starts[rest] - (np.cumsum(each_rest) - each_rest), each_rest) + np.arange(c.size)
    out_c[at], out_l[at] = c, ln
    return out_c, out_l, each


#: MCUs in a restart interval.
INTERVAL = 2

#: The scans of a written image: first to last coefficient, bit position before (0: first scan) and after.
SCRIPT = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]


def write(coefficients: list[np.ndarray], images: list[Image]) -> list[bytes]:
    """JPEG files of quantised coefficients (rows of 64, in natural order, as Image.lay_out has them); quantisers are 1.

    Every INTERVAL MCUs of a scan are a restart interval.
    """
    counts, symbols = own_tables()
    codes, lengths = code_table(counts, symbols)
    table = bytes(counts) + bytes(symbols)
    starts = np.cumsum([0] + [im.blocks for im in images])
    coefs = np.concatenate(coefficients)[:, ZIGZAG] if coefficients else np.zeros((0, 64), np.int64)
    out = [bytearray(bytes([0xFF, SOI]) + segment(DQT, b"\0" + b"\1" * 64)) for _ in images]
    for at, im in enumerate(images):
        frame = bytes([8]) + im.height.to_bytes(2, "big") + im.width.to_bytes(2, "big") + bytes([len(im.components)])
        frame += b"".join(bytes([c.id, c.h << 4 | c.v, 0]) for c in im.components)
        out[at] += segment(SOF2, frame) + segment(DHT, b"\x00" + table) + segment(DHT, b"\x10" + table) + segment(DRI, INTERVAL.to_bytes(2, "big"))
    for first, last, high, low in SCRIPT:
        groups = [list(range(max(len(im.components) for im in images)))] if first == 0 else [[i] for i in range(max(len(im.components) for im in images))]
        for group in groups:
            those = [(at, im) for at, im in enumerate(images) if len(im.components) > max(group) or first == 0]
            orders, lane_sizes = [], []
            for at, im in those:
                which = [i for i in group if i < len(im.components)]
                rows, places, lane = im.scan_order(which)
                lane *= INTERVAL
                orders.append((starts[at] + rows, places, lane))
                sizes = np.full(-(-rows.size // lane), lane)
                sizes[-1] = rows.size - lane * (sizes.size - 1)
                lane_sizes.append(sizes)
            rows = np.concatenate([o[0] for o in orders])
            lanes = np.concatenate(lane_sizes)
            if first == 0 and high == 0:
                parts = [dc_first(coefs[r, 0], p, lane, low, codes, lengths) for r, p, lane in orders]
                c, ln = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                ends = np.cumsum(lanes)
            elif first == 0:
                c, ln, ends = coefs[rows, 0] >> low & 1, np.ones(rows.size, np.int64), np.cumsum(lanes)
            else:
                c, ln, each = by_block(coefs[rows, first : last + 1], high, low, codes, lengths)
                ends = np.cumsum(each)
                if lanes.size != rows.size:
                    ends = ends[np.cumsum(lanes) - 1]
            data = entropy_coded(*pack(c, ln, ends), np.array([x.size for x in lane_sizes]))
            for (at, im), mine in zip(those, data):
                which = [i for i in group if i < len(im.components)]
                head = bytes([len(which)]) + b"".join(bytes([im.components[i].id, 0]) for i in which) + bytes([first, last, high << 4 | low])
                out[at] += segment(SOS, head) + mine
    return [bytes(x + bytes([0xFF, EOI])) for x in out]


# ---------------------------------------------------------------- reading


def parse(data: bytes) -> Image:
    """Headers, tables and scans of a progressive image."""
    at, image, restart = 2, None, 0
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], tuple] = {}
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG")
    raw = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    markers = full[(after != 0) & ((after < RST0) | (after >= RST0 + 8))]
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == EOI:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                natural = np.zeros(64, np.int64)
                natural[ZIGZAG] = values
                quant[body[0] & 15] = natural
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                counts = list(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == DRI:
            restart = int.from_bytes(body, "big")
        elif marker == SOF2:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
            image.lay_out()
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("the image isn't a progressive one with Huffman codes")
        elif marker == SOS:
            n = body[0]
            ids = [c.id for c in image.components]
            which = [ids.index(body[1 + 2 * i]) for i in range(n)]
            used = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            nth = int(np.searchsorted(markers, at))
            stop = int(markers[nth]) if nth < markers.size else len(data)
            dc = {k[1]: v for k, v in tables.items() if k[0] == 0}
            ac = {k[1]: v for k, v in tables.items() if k[0] == 1}
            image.scans.append(Scan(which, used, start, end, bits >> 4, bits & 15, restart, data[at:stop], dc, ac))
            at = stop
    image.quant = quant
    return image


class Bits:
    """All lanes' bits: 64 bits from any byte on, with the stuffed bytes gone and lanes found."""

    def __init__(self, scans: list[bytes]):
        raw = np.frombuffer(b"".join([s + b"\xff\xd0" for s in scans]), np.uint8)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[full + 1]
        marks = full[(after >= RST0) & (after < RST0 + 8)]
        gone = np.zeros(raw.size, bool)
        gone[full[after == 0] + 1] = True
        gone[marks] = gone[marks + 1] = True
        keep = np.flatnonzero(~gone)
        self.lane_ends = np.searchsorted(keep, marks) * 8
        self.lane_starts = np.concatenate(([0], self.lane_ends[:-1]))
        lanes_of = np.searchsorted(marks, np.cumsum([len(s) + 2 for s in scans]))
        self.lanes = np.diff(np.concatenate(([0], lanes_of)))
        data = np.concatenate((raw[keep], np.full(16, 0xFF, np.uint8))).astype(np.uint64)
        word = np.zeros(data.size - 8, np.uint64)
        for i in range(8):
            word |= data[i : i + word.size] << np.uint64(56 - 8 * i)
        self.word = word

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least, from the top."""
        return self.word[np.minimum(at >> 3, self.word.size - 1)] << (at & 7).astype(np.uint64)


def top(window: np.ndarray, n) -> np.ndarray:
    """The top n bits, n up to 63; none for 0."""
    return ((window >> np.uint64(1)) >> (np.uint64(63) - np.asarray(n, np.uint64))).astype(np.int64)


def signed_value(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


class Lanes:
    """The state of the restart intervals that are decoded side by side."""

    def __init__(self, bits: Bits, orders: list[tuple[np.ndarray, np.ndarray, int]], restarts: list[int], shift: list[int]):
        self.bits = bits
        rows, first, count = [], [], []
        base = 0
        for (r, _, mcu), restart, start, lanes in zip(orders, restarts, shift, bits.lanes.tolist()):
            size = restart * mcu if restart else r.size
            begins = np.arange(0, r.size, size) if r.size else np.zeros(0, np.int64)
            if begins.size != lanes:
                raise ValueError("restart markers and image size don't agree")
            rows.append(start + r)
            first.append(base + begins)
            count.append(np.minimum(size, r.size - begins))
            base += r.size
        self.rows, self.first, self.count = np.concatenate(rows), np.concatenate(first), np.concatenate(count)
        self.place = np.concatenate([p for _, p, _ in orders])
        self.pos = bits.lane_starts.copy()


def read_dc(lanes: Lanes, coefs: np.ndarray, luts: np.ndarray, lut_of: np.ndarray, scan: Scan) -> None:
    """luts: a row of lookups for each table; lut_of: the table of each block in scan order."""
    if scan.high:
        for step in range(int(lanes.count.max(initial=0))):
            on = np.flatnonzero(lanes.count > step)
            bit = top(lanes.bits.peek(lanes.pos[on]), 1)
            coefs[lanes.rows[lanes.first[on] + step], 0] |= bit << scan.low
            lanes.pos[on] += 1
        return
    before = np.zeros((lanes.first.size, 4), np.int64)
    for step in range(int(lanes.count.max(initial=0))):
        on = np.flatnonzero(lanes.count > step)
        at = lanes.first[on] + step
        window = lanes.bits.peek(lanes.pos[on])
        found = luts[lut_of[at], top(window, 16)]
        length, size = found & 31, found >> 5
        value = top(window << length.astype(np.uint64), size)
        lanes.pos[on] += length + size
        place = lanes.place[at]
        before[on, place] += signed_value(value, size)
        coefs[lanes.rows[at], 0] = before[on, place] << scan.low


def read_ac_first(lanes: Lanes, coefs: np.ndarray, lut: np.ndarray, lut_of: np.ndarray, scan: Scan) -> None:
    n = lanes.first.size
    block, k = np.zeros(n, np.int64), np.full(n, scan.start)
    on = np.flatnonzero(lanes.count > 0)
    pos, flat = lanes.pos, coefs.reshape(-1)
    while on.size:
        window = lanes.bits.peek(pos[on])
        at = lanes.first[on] + block[on]
        found = lut[lut_of[at], top(window, 16)]
        length, symbol = found & 31, found >> 5
        run, size = symbol >> 4, symbol & 15
        rest = window << length.astype(np.uint64)
        ends = (size == 0) & (run < 15)
        more = np.where(ends, run, size)
        value = top(rest, more)
        pos[on] += length + more
        kk = k[on] + np.where(ends, 0, run)
        put = size > 0
        flat[lanes.rows[at[put]] * 64 + kk[put]] = signed_value(value[put], size[put]) << scan.low
        kk += 1
        # An end of blocks takes this block and as many more as its bits say.
        skip = np.where(ends, (1 << run) + value, np.where(kk > scan.end, 1, 0))
        k[on] = np.where(skip > 0, scan.start, kk)
        block[on] += skip
        on = on[block[on] < lanes.count[on]]


def read_corrections(lanes: Lanes, coefs: np.ndarray, on: np.ndarray, row: np.ndarray, length: np.ndarray, scan: Scan) -> None:
    """One correction bit for each coefficient of blocks in which none is zero, after a code of ``length`` bits."""
    width = scan.end - scan.start + 1
    lanes.pos[on] += length
    for begin in range(0, width, 32):
        wide = min(32, width - begin)
        bits = top(lanes.bits.peek(lanes.pos[on]), wide)[:, None] >> np.arange(wide - 1, -1, -1) & 1
        old = coefs[row, scan.start + begin : scan.start + begin + wide]
        coefs[row, scan.start + begin : scan.start + begin + wide] = old + np.where(old > 0, bits, -bits) * (1 << scan.low)
        lanes.pos[on] += wide


def read_ac_refine(lanes: Lanes, coefs: np.ndarray, lut: np.ndarray, lut_of: np.ndarray, scan: Scan) -> None:
    """One symbol of each lane a step. The correction bits up to the place that the symbol means are read at once."""
    n, width = lanes.first.size, scan.end - scan.start + 1
    block, k, eobs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = np.flatnonzero(lanes.count > 0)
    column = np.arange(width)
    while on.size:
        row = lanes.rows[lanes.first[on] + block[on]]
        band = coefs[row, scan.start : scan.end + 1]
        whole = (k[on] == 0) & band.all(axis=1)
        if whole.any():
            some = on[whole]
            window = lanes.bits.peek(lanes.pos[some])
            found = lut[lut_of[lanes.first[some] + block[some]], top(window, 16)]
            plain = (eobs[some] == 0) & (found >> 5 == EOB)
            some = some[plain]
            if some.size:
                read_corrections(lanes, coefs, some, row[whole][plain], (found & 31)[plain], scan)
                block[some] += 1
                on = on[block[on] < lanes.count[on]]
                continue
        known, from_k = band != 0, column >= k[on][:, None]
        window = lanes.bits.peek(lanes.pos[on])
        found = lut[lut_of[lanes.first[on] + block[on]], top(window, 16)]
        length, symbol = found & 31, found >> 5
        within = eobs[on] > 0  # an end of blocks that came earlier covers this block
        length, symbol = np.where(within, 0, length), np.where(within, 0, symbol)
        run, size = symbol >> 4, symbol & 15
        ends = within | (size == 0) & (run < 15)
        rest = window << length.astype(np.uint64)
        more = np.where(within, 0, np.where(ends, run, size))
        value = top(rest, more)
        eobs[on] = np.where(within, eobs[on], np.where(ends, (1 << run) + value, 0))
        lanes.pos[on] += length + more
        # The place: after ``run`` zeros, the next zero; none if the block ends.
        zeros = np.cumsum(~known & from_k, axis=1)
        reach = from_k & ((zeros <= run[:, None]) | ends[:, None])
        target = np.where(ends, width, (zeros <= run[:, None]).sum(axis=1))
        fix = known & reach & (column < target[:, None])
        r, c = np.nonzero(fix)
        if r.size:
            nth = (np.cumsum(fix, axis=1) - 1)[r, c]
            bit = top(lanes.bits.peek(lanes.pos[on][r] + nth), 1)
            old = band[r, c]
            coefs[row[r], scan.start + c] = old + np.where(old > 0, bit, -bit) * (1 << scan.low)
        lanes.pos[on] += fix.sum(axis=1)
        new = (size > 0) & (target < width)
        coefs[row[new], scan.start + target[new]] = np.where(value[new] > 0, 1, -1) << scan.low
        k[on] = target + 1
        over = (k[on] >= width) | ends
        eobs[on] = np.where(ends, eobs[on] - 1, eobs[on])
        block[on] += over
        k[on] = np.where(over, 0, k[on])
        on = on[block[on] < lanes.count[on]]


def accumulate(images: list[Image]) -> np.ndarray:
    """All images' quantised coefficients, rows of 64 in natural order, one image after another.

    The i-th scans of all images that have the same parameters are decoded together.
    """
    starts = np.cumsum([0] + [im.blocks for im in images])
    coefs = np.zeros((int(starts[-1]), 64), np.int64)
    cache: dict = {}

    def lut(table) -> np.ndarray:
        if table not in cache:
            cache[table] = lookup_table(list(table[0]), list(table[1]))
        return cache[table]

    for i in range(max((len(im.scans) for im in images), default=0)):
        groups: dict = {}
        for at, im in enumerate(images):
            if i < len(im.scans):
                s = im.scans[i]
                groups.setdefault((s.start, s.end, s.high, s.low), []).append(at)
        for those in groups.values():
            scans = [images[at].scans[i] for at in those]
            orders = [images[at].scan_order(s.components) for at, s in zip(those, scans)]
            lanes = Lanes(Bits([s.data for s in scans]), orders, [s.restart for s in scans], [int(starts[at]) for at in those])
            one = scans[0]
            tables, lut_of = [], []
            for s, (_, place, _) in zip(scans, orders):
                own = []
                for dc, ac in s.tables:
                    t = s.dc.get(dc) if one.start == 0 else s.ac.get(ac)
                    if t is None:
                        if not (one.start == 0 and one.high):
                            raise ValueError("a Huffman table is missing")
                        t = ((0,) * 16, ())
                    if t not in tables:
                        tables.append(t)
                    own.append(tables.index(t))
                lut_of.append(np.array(own)[place])
            luts = np.stack([lut(t) for t in tables])
            reader = read_dc if one.start == 0 else read_ac_refine if one.high else read_ac_first
            reader(lanes, coefs, luts, np.concatenate(lut_of), one)
    natural = np.empty_like(coefs)
    natural[:, ZIGZAG] = coefs
    return natural


# ---------------------------------------------------------------- pixels


def cosine_basis() -> np.ndarray:
    """Row u: the u-th cosine at the eight samples."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis.astype(np.float32)


def planes(image: Image, coefs: np.ndarray) -> list[np.ndarray]:
    """Each component's samples, without rounding, from its dequantised blocks."""
    basis = cosine_basis()
    out = []
    for c in image.components:
        own = coefs[c.first : c.first + c.wide * c.high].astype(np.float32) * image.quant[c.quant].astype(np.float32)
        pixels = basis.T @ own.reshape(-1, 8, 8) @ basis + np.float32(128)
        out.append(pixels.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8))
    return out


def to_rgb(image: Image, coefs: np.ndarray) -> np.ndarray:
    """height x width x 3 bytes: chroma is repeated to full resolution; one component is grey."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, plane in zip(image.components, planes(image, coefs)):
        if (c.h, c.v) != (hmax, vmax):
            plane = plane.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
        full.append(plane[: image.height, : image.width])
    if len(full) == 1:
        rgb = np.stack([full[0]] * 3, axis=-1)
    else:
        y, b, r = full[0], full[1] - 128, full[2] - 128
        rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
