"""Baseline JPEG in numpy: parse the markers, Huffman-decode the scans of many images in lockstep, and
rebuild luminance thumbnails from the DC coefficients alone, one pixel for each 8 x 8 block.

The decoder treats every restart interval of every image as a lane. In each step all lanes decode one
Huffman symbol, so the Python loop runs over symbols of the longest interval and not over the symbols of
all images. The writer makes grey images whose blocks have a DC coefficient only; with a quantiser of 8 a block is one
flat 8-bit sample, so the thumbnail gives each sample back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Blocks in a row of a written image, and in a restart interval.
ROW = 24
#: Most block rows of one image: 65,472 pixels of height.
MOST_ROWS = 8184
#: Bit lengths of the DC categories 0 to 8 in the written table, as the counts of codes of each length 1 to 16.
DC_COUNTS = (0, 1, 5, 1, 1, 1) + (0,) * 10
DC_SYMBOLS = tuple(range(9))
#: The only AC symbol of a written image is the end of the block, in one bit.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)
FF, STUFF, RST0, SOI, EOI = 0xFF, 0x00, 0xD0, b"\xff\xd8", b"\xff\xd9"


class JpegError(ValueError):
    """The bytes are not a baseline JPEG that this module reads."""


@lru_cache(maxsize=64)
def code_table(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit window: the symbol its first bits spell, and their number (0: none)."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - bits)
            symbol[low : low + (1 << (16 - bits))] = symbols[at]
            length[low : low + (1 << (16 - bits))] = bits
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


@lru_cache(maxsize=32)
def flat_block_table(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit window: the DC difference and the length of a whole block without AC coefficients,
    or length 0 if the window does not hold one."""
    (dc_symbol, dc_length), (ac_symbol, ac_length) = code_table(*dc), code_table(*ac)
    window = np.arange(1 << 16)
    category, length = dc_symbol.astype(np.int64), dc_length.astype(np.int64)
    behind = np.minimum(length + category, 16)
    end = (window << behind) & 0xFFFF
    total = length + category + ac_length[end]
    whole = (length > 0) & (ac_length[end] > 0) & (ac_symbol[end] == 0) & (total <= 16)
    extra = (window >> (16 - behind)) & ((1 << category) - 1)
    value = np.where((category > 0) & (extra < (1 << np.maximum(category - 1, 0))), extra - (1 << category) + 1, extra)
    return np.where(whole, value, 0).astype(np.int32), np.where(whole, total, 0).astype(np.int64)


# --- writing ---------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((FF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    """Everything before the scan data of a grey image of `rows` rows of `ROW` blocks."""
    size = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return (
        SOI
        + _segment(0xDB, bytes([0] + [8] * 64))
        + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _segment(0xDD, ROW.to_bytes(2, "big"))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of a whole block (DC difference and end of block), by difference plus 255."""
    codes, code = {}, 0
    at = 0
    for bits, n in enumerate(DC_COUNTS, 1):
        for _ in range(n):
            codes[DC_SYMBOLS[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for difference in range(-255, 256):
        category = abs(difference).bit_length()
        prefix, bits = codes[category]
        extra = difference if difference >= 0 else difference + (1 << category) - 1
        value[difference + 255] = ((prefix << category) | extra) << 1
        length[difference + 255] = bits + category + 1
    return value, length


_CODE, _BITS = _difference_codes()


def write_images(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload, whose length is a positive multiple of `ROW`: one image, or for long
    payloads several, one behind the other. Every row of blocks is a restart interval."""
    # Columns of blocks lie together, so that the loop over them runs through memory in order.
    samples = np.ascontiguousarray(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).T).astype(np.int16)
    difference = samples.copy()
    difference[0] -= 128
    difference[1:] -= samples[:-1]
    rows = samples.shape[1]
    line = np.arange(rows)
    wide = np.zeros((rows, ROW * 2 + 4), np.uint8)
    flat, row_start, end = wide.ravel(), line * wide.shape[1], np.zeros(rows, np.int64)
    for column in range(ROW):
        index = difference[column] + np.int16(255)
        bits = _BITS[index]
        at = row_start + (end >> 3)
        shifted = _CODE[index] << (32 - bits - (end & 7)).astype(np.uint32)
        for step in range(3):
            flat[at + step] |= (shifted >> np.uint32(24 - 8 * step)).astype(np.uint8)
        end += bits
    size = (end + 7) >> 3
    spare = (size << 3) - end
    flat[row_start + size - 1] |= ((1 << spare) - 1).astype(np.uint8)
    used = np.arange(wide.shape[1]) < size[:, None]
    data, row_of = wide[used], np.repeat(line, size)
    # Where a row's bytes go: behind the stuffing bytes before them, and two marker bytes for every row before.
    full = data == FF
    place = np.arange(len(data)) + np.cumsum(full) - full + 2 * row_of
    out = np.zeros(len(data) + int(full.sum()) + 2 * rows, np.uint8)
    out[place] = data
    last = np.cumsum(size) - 1
    mark = place[last] + 1 + full[last]
    out[mark] = FF
    # Rows of an image count from its own start; the last ends with the end of the image.
    counts = [len(p) // ROW for p in payloads]
    first_rows = [(start, min(MOST_ROWS, n - start)) for n in counts for start in range(0, n, MOST_ROWS)]
    lengths = np.array([n for _, n in first_rows])
    offsets = np.cumsum(lengths) - lengths
    inside = line - np.repeat(offsets, lengths)
    out[mark + 1] = RST0 + (inside & 7)
    out[mark[offsets + lengths - 1] + 1] = EOI[1]
    cuts = np.concatenate([[0], mark[offsets + lengths - 1] + 2])
    raw = out.tobytes()
    images = [header(int(n)) + raw[cuts[i] : cuts[i + 1]] for i, n in enumerate(lengths)]
    made, at = [], 0
    for n in counts:
        k = -(-n // MOST_ROWS)
        made.append(b"".join(images[at : at + k]))
        at += k
    return made


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    """What the markers of one image say, and where its scan data lie."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    restart: int = 0
    scan: tuple[int, int] = (0, 0)
    order: list[Component] = field(default_factory=list)

    @property
    def units(self) -> tuple[int, int]:
        """MCUs across and down."""
        wide, high = (max((getattr(c, n) for c in self.components), default=1) for n in ("across", "down"))
        if len(self.order) == 1:
            wide = high = 1
        return -(-self.width // (8 * wide)), -(-self.height // (8 * high))


def parse(data: bytes, start: int = 0) -> tuple[Frame, int]:
    """The frame of the image that starts at `start`, and the offset behind it."""
    if data[start : start + 2] != SOI:
        raise JpegError("no start of image")
    frame, at = Frame(), start + 2
    while at + 2 <= len(data):
        if data[at] != FF:
            raise JpegError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == FF:
            at += 1
            continue
        if marker == EOI[1]:
            return frame, at + 2
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise JpegError("a segment is cut short")
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = 2 if body[i] >> 4 else 1
                frame.quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 1 + wide], "big")
                i += 1 + 64 * wide
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("only 8-bit samples are read")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError("not a baseline image")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = tuple(body[i + 1 : i + 17])
                frame.tables[body[i] >> 4, body[i] & 15] = counts, tuple(body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            by_number = {c.number: c for c in frame.components}
            frame.order = []
            for i in range(1, 1 + 2 * body[0], 2):
                component = by_number[body[i]]
                component.dc, component.ac = body[i + 1] >> 4, body[i + 1] & 15
                frame.order.append(component)
            end = at + 2 + size
            while True:
                found = data.find(b"\xff", end)
                if found < 0 or found + 1 >= len(data):
                    raise JpegError("the scan has no end")
                if data[found + 1] == STUFF or RST0 <= data[found + 1] <= RST0 + 7:
                    end = found + 2
                    continue
                break
            if len(frame.order) != len(frame.components):
                raise JpegError("only single-scan images are read")
            frame.scan = (at + 2 + size, found)
            at = found
            continue
        at += 2 + size
    raise JpegError("no end of image")


def parse_all(data: bytes) -> list[Frame]:
    frames, at = [], 0
    while at < len(data):
        frame, at = parse(data, at)
        frames.append(frame)
    return frames


def _scan_lanes(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and where each interval starts."""
    after = np.flatnonzero(scan[:-1] == FF)
    follow = scan[after + 1]
    keep = np.ones(len(scan), bool)
    keep[after[follow == STUFF] + 1] = False
    marks = after[(follow & 0xF8) == RST0]
    keep[marks] = keep[marks + 1] = False
    before = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], before[marks]])


def thumbnails(streams: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails of the images of each stream, decoded together."""
    parsed = [[(frame, stream) for frame in parse_all(stream)] for stream in streams]
    every = [x for images in parsed for x in images]
    made: list[np.ndarray | None] = [None] * len(every)
    kinds: dict[tuple, list[int]] = {}
    for at, (frame, _) in enumerate(every):
        layout = tuple((c.across, c.down, c.dc, c.ac, frame.tables[0, c.dc], frame.tables[1, c.ac]) for c in frame.order)
        kinds.setdefault(layout, []).append(at)
    for layout, members in kinds.items():
        for at, pixels in zip(members, _decode(layout, [every[i] for i in members]), strict=True):
            made[at] = pixels
    out, at = [], 0
    for images in parsed:
        out.append(made[at : at + len(images)])
        at += len(images)
    return out


def _decode(layout: tuple, images: list[tuple[Frame, bytes]]) -> list[np.ndarray]:
    """Thumbnails of images that share sampling factors and Huffman tables."""
    single = len(layout) == 1
    blocks = [(c, v, h) for c, (across, down, *_) in enumerate(layout) for v in range(1 if single else down) for h in range(1 if single else across)]
    tables = [(code_table(*dc), code_table(*ac)) for *_, dc, ac in layout]
    flat = [flat_block_table(dc, ac) for *_, dc, ac in layout]
    chunks, starts, counts, firsts, base = [], [], [], [], 0
    luma_per_unit = sum(c == 0 for c, _, _ in blocks)
    total_units = 0
    for frame, stream in images:
        data, lanes = _scan_lanes(np.frombuffer(stream, np.uint8, frame.scan[1] - frame.scan[0], frame.scan[0]))
        units = frame.units[0] * frame.units[1]
        step = frame.restart or max(units, 1)
        if len(lanes) != -(-units // step):
            raise JpegError("the restart markers do not fit the size")
        first = np.arange(len(lanes)) * step
        counts.append(np.minimum(step, units - first))
        firsts.append(first + total_units)
        starts.append(lanes + base)
        chunks += [data, np.full(8, FF, np.uint8)]
        base += len(data) + 8
        total_units += units
    data = np.concatenate(chunks).astype(np.uint64)
    # The 40 bits from each byte on, so that one look-up serves a code and the bits behind it.
    window = np.zeros(len(data), np.uint64)
    for i in range(5):
        window[: len(data) - i] |= data[i:] << np.uint64(32 - 8 * i)
    position = np.concatenate(starts) * 8
    left = np.concatenate(counts)
    unit = np.concatenate(firsts)
    end_bits = len(data) * 8
    luma = np.zeros((total_units, max(luma_per_unit, 1)), np.int32)
    live = np.flatnonzero(left > 0)
    previous = np.zeros((len(layout), len(position)), np.int32)
    while len(live):
        seen_luma = 0
        for component, _, _ in blocks:
            (dc_symbol, dc_length), (ac_symbol, ac_length) = tables[component]
            at = position[live]
            if (at >= end_bits - 32).any():
                raise JpegError("the scan ends within a block")
            flat_value, flat_length = flat[component]
            head = ((window[at >> 3] >> (np.uint64(24) - (at & 7).astype(np.uint64))) & np.uint64(0xFFFF)).astype(np.int64)
            length = flat_length[head]
            if length.all():
                previous[component, live] += flat_value[head]
                if component == 0:
                    luma[unit[live], seen_luma] = previous[0, live]
                    seen_luma += 1
                position[live] = at + length
                continue
            bits = (window[at >> 3] << (np.uint64(24) + (at & 7).astype(np.uint64))) >> np.uint64(32)
            head = (bits >> np.uint64(16)).astype(np.int64)
            category, length = dc_symbol[head].astype(np.int64), dc_length[head].astype(np.int64)
            if not length.all() or (category > 11).any():
                raise JpegError("a DC code is not in the table")
            extra = ((bits >> (32 - length - category).astype(np.uint64)).astype(np.int64)) & ((1 << category) - 1)
            value = np.where((category > 0) & (extra < (1 << np.maximum(category - 1, 0))), extra - (1 << category) + 1, extra)
            previous[component, live] += value.astype(np.int32)
            at = at + length + category
            if component == 0:
                luma[unit[live], seen_luma] = previous[0, live]
                seen_luma += 1
            # AC coefficients: passed over, until every lane has ended its block.
            k = np.ones(len(live), np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                here = at[open_]
                if (here >= end_bits - 16).any():
                    raise JpegError("the scan ends within a block")
                head = ((window[here >> 3] >> (np.uint64(24) - (here & 7).astype(np.uint64))) & np.uint64(0xFFFF)).astype(np.int64)
                symbol, length = ac_symbol[head].astype(np.int64), ac_length[head].astype(np.int64)
                if not length.all():
                    raise JpegError("an AC code is not in the table")
                at[open_] = here + length + (symbol & 15)
                k[open_] = np.where(symbol == 0, 64, k[open_] + (symbol >> 4) + 1)
                open_ = open_[k[open_] < 64]
            position[live] = at
        unit[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    out, done = [], 0
    for frame, _ in images:
        wide, high = frame.units
        n = wide * high
        part = luma[done : done + n].astype(np.int64) * frame.quantisers[frame.order[0].quantiser]
        done += n
        down, across = (1, 1) if single else (layout[0][1], layout[0][0])
        grid = part.reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
        # The mean of a block is its DC coefficient over 8, around 128.
        pixels = np.clip((grid + (1024 + 4)) >> 3, 0, 255).astype(np.uint8)
        top = max((c.down for c in frame.components), default=1)
        side = max((c.across for c in frame.components), default=1)
        first = frame.order[0]
        rows, columns = -(-frame.height * first.down // (8 * top)), -(-frame.width * first.across // (8 * side))
        out.append(pixels if single else pixels[:rows, :columns])
    return out
