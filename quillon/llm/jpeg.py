"""Progressive JPEG in numpy: spectral selection, successive approximation, and RGB tensors.

The reader takes the scans of a file one after another and gathers them in coefficient arrays: a
scan adds a band of coefficients (spectral selection) or one more bit of them (successive
approximation). The coefficients are then dequantised, inverse-transformed, chroma is upsampled to
full resolution, and the planes become an RGB tensor. All of it is integer arithmetic, so equal
files give equal tensors.

Entropy-coded data are decoded side by side: every restart interval of every file of a batch is a
lane, and a numpy step reads one symbol of each lane. A file without restart markers is one lane a scan.

The writer stores bytes as coefficients, eight bits each, in files of three components with every
block a restart interval of its own in the AC scans; what it stores is read back bit for bit.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order of an 8x8 block follows its antidiagonals, up and down by turns.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))


def _basis() -> np.ndarray:
    """64x64: the pixels of a block from its coefficients in zigzag order, in 2 ** -13."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[:, 0] = np.sqrt(1 / 8)
    full = np.einsum("yv,xu->yxvu", c, c).reshape(64, 64)[:, ZIGZAG]
    return np.rint(full * (1 << 13))


BASIS = _basis()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    cols: int = 0  # blocks in a row, as far as the picture goes
    rows: int = 0
    wide: int = 0  # blocks in a row of the coefficient array, whole MCUs
    at: int = 0  # first block in the batch's array
    blocks: int = 0


@dataclass
class Scan:
    parts: list[tuple[int, int, int]]  # component, DC table, AC table
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    data: bytes
    dc: dict[int, bytes]
    ac: dict[int, bytes]


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    end: int = 0  # where the file ends in the bytes that it was read from

    @property
    def hmax(self) -> int:
        return max(c.h for c in self.components)

    @property
    def vmax(self) -> int:
        return max(c.v for c in self.components)


def parse(data: bytes, at: int = 0) -> Picture:
    """The segments of the baseline or progressive JPEG file with 8-bit samples that begins at `at`."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, restart = Picture(), at + 2, 0
    dc: dict[int, bytes] = {}
    ac: dict[int, bytes] = {}
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            out.end = at + 2
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                out.quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1, 0xC2):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("only 8-bit grey or colour is read")
            out.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            mcus = -(-out.width // (8 * out.hmax)), -(-out.height // (8 * out.vmax))
            for c in out.components:
                c.cols, c.rows = -(-out.width * c.h // (8 * out.hmax)), -(-out.height * c.v // (8 * out.vmax))
                c.wide, c.blocks = mcus[0] * c.h, mcus[0] * c.h * mcus[1] * c.v
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            idents = [c.ident for c in out.components]
            parts = [(idents.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            ss, se, a = body[-3:]
            end = at
            while True:  # entropy-coded data go on over stuffed bytes and restart markers
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("the file is cut short")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            out.scans.append(Scan(parts, ss, se, a >> 4, a & 15, restart, data[at:end], dict(dc), dict(ac)))
            at = end
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("this kind of JPEG is not read")
    if not out.components or not out.end:
        raise ValueError("the file is cut short")
    return out


def split(data: bytes) -> list[Picture]:
    """The pictures of files that stand one after another."""
    out = [parse(data)]
    while out[-1].end < len(data):
        out.append(parse(data, out[-1].end))
    return out


def huffman_lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: code length << 8 | symbol; length 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = length << 8 | symbol
            code += 1
        at += table[length - 1]
        code <<= 1
    return out


class _Bits:
    """A bit reader for many lanes over one array of bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray) -> None:
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.at = start.astype(np.int64) * 8
        self.most = len(self.words) - 1

    def peek16(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        word = self.words[np.minimum(at >> 3, self.most)]
        return ((word >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)

    def take(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits of each lane, 16 at most."""
        got = self.peek16(lanes) >> (16 - n)
        self.at[lanes] += n
        return got


    def single(self, lanes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """The one bit that is so far ahead of where each lane stands."""
        at = self.at[lanes] + ahead
        return ((self.words[np.clip(at >> 3, 0, self.most)] >> (31 - (at & 7)).astype(np.uint32)) & 1).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _intervals(scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scans' bytes without stuffing and markers; where each restart interval begins; the intervals of each scan."""
    sizes = np.array([len(s.data) + 4 for s in scans])
    ends = np.cumsum(sizes)
    a = np.frombuffer(b"".join(s.data + b"\0\0\0\0" for s in scans), np.uint8)
    ff = np.flatnonzero(a[:-1] == 0xFF)
    after = a[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(a) + 1, bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    starts = np.sort(np.concatenate([ends - sizes, marks + 2]))
    moved = np.cumsum(keep) - keep
    return a[keep[:-1]], moved[starts], np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(scans))


def _lane_blocks(picture: Picture, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(blocks in coding order, their component) of a scan."""
    if len(scan.parts) == 1:  # not interleaved: only blocks that the picture reaches
        n = scan.parts[0][0]
        c = picture.components[n]
        count = c.cols * c.rows
        order = np.arange(c.at, c.at + count)
        if c.cols < c.wide:
            order += np.repeat(np.arange(c.rows) * (c.wide - c.cols), c.cols)
        return order, np.full(count, n)
    first = picture.components[scan.parts[0][0]]
    across, down = first.wide // first.h, first.blocks // first.wide // first.v
    shifts, comps, steps = [], [], []
    for n, _, _ in scan.parts:
        c = picture.components[n]
        for y in range(c.v):
            for x in range(c.h):
                shifts.append(c.at + y * c.wide + x)
                steps.append((c.v * c.wide, c.h))
                comps.append(n)
    my, mx = np.divmod(np.arange(across * down), across)
    down_by, across_by = np.array(steps).T
    return (np.array(shifts) + my[:, None] * down_by + mx[:, None] * across_by).ravel(), np.tile(comps, across * down)


def _decode_scans(group: list[tuple[Picture, Scan]], coefficients: np.ndarray) -> None:
    """Add scans of one kind (band and bits) to the coefficients; their intervals are the lanes."""
    ss, se, ah, al = (getattr(group[0][1], k) for k in ("ss", "se", "ah", "al"))
    data, starts, counts = _intervals([scan for _, scan in group])
    orders, comps, tables, lengths, lookups = [], [], [], [], []
    known: dict[bytes, int] = {}
    for (picture, scan), count in zip(group, counts.tolist(), strict=True):
        order, comp = _lane_blocks(picture, scan)
        per_mcu = 1 if len(scan.parts) == 1 else sum(picture.components[n].h * picture.components[n].v for n, _, _ in scan.parts)
        step = scan.restart * per_mcu if scan.restart else max(1, len(order))
        if count != -(-len(order) // step):
            raise ValueError("restart markers are missing")
        table_of = np.zeros(4, np.int64)
        for n, dc, ac in scan.parts:
            raw = (scan.ac[ac] if ss else scan.dc[dc]) if ss or not ah else b""
            if raw not in known:
                known[raw] = len(lookups)
                lookups.append(huffman_lookup(raw) if raw else np.zeros(1 << 16, np.int32))
            table_of[n] = known[raw]
        orders.append(order)
        comps.append(comp)
        tables.append(table_of[comp] << 16)
        lengths.append(np.full(count, step))
        lengths[-1][-1] = len(order) - step * (count - 1)
    lookup, order, comp, table, lengths = (np.concatenate(x) for x in (lookups, orders, comps, tables, lengths))
    first = np.cumsum(lengths) - lengths
    bits = _Bits(data, starts)
    flat = coefficients.reshape(-1)
    if ss == 0:
        _decode_dc(bits, lookup, order, comp, table, first, lengths, ah, al, coefficients)
    elif ah == 0:
        _decode_ac_first(bits, lookup, order, table, first, lengths, ss, se, al, flat)
    else:
        _decode_ac_refine(bits, lookup, order, table, first, lengths, ss, se, al, flat)


def _symbols(bits: _Bits, lookup: np.ndarray, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
    got = lookup[table + bits.peek16(lanes)]
    length = got >> 8
    if not length.all():
        raise ValueError("no such code")
    bits.at[lanes] += length
    return got & 255


def _decode_dc(bits, lookup, order, comp, table, first, lengths, ah, al, coefficients) -> None:  # noqa: ANN001
    last = np.zeros((len(lengths), 4), np.int64)
    for step in range(int(lengths.max(initial=0))):
        lanes = np.flatnonzero(lengths > step)
        block = first[lanes] + step
        if ah:
            coefficients[order[block], 0] |= bits.take(lanes, np.ones(len(lanes), np.int64)) << al
            continue
        size = _symbols(bits, lookup, lanes, table[block])
        last[lanes, comp[block]] += _extend(bits.take(lanes, size), size)
        coefficients[order[block], 0] = last[lanes, comp[block]] << al


def _decode_ac_first(bits, lookup, order, table, first, lengths, ss, se, al, flat) -> None:  # noqa: ANN001
    """Each turn reads a symbol of every lane that isn't through."""
    lanes = np.flatnonzero(lengths > 0)
    block = first[lanes].copy()
    end = block + lengths[lanes]
    k = np.full(len(lanes), ss)
    while len(lanes):
        symbol = _symbols(bits, lookup, lanes, table[block])
        run, size = symbol >> 4, symbol & 15
        value = size > 0
        if value.all():
            k += run
            if (k > se).any():
                raise ValueError("a run leaves its band")
            flat[order[block] * 64 + k] = _extend(bits.take(lanes, size), size) << al
            k += 1
        else:
            got = _extend(bits.take(lanes, size), size)
            k += np.where(value | (run == 15), run, 0)
            if (k[value] > se).any():
                raise ValueError("a run leaves its band")
            flat[order[block[value]] * 64 + k[value]] = got[value] << al
            k += value | (run == 15)
            eob = ~value & (run < 15)
            skipped = bits.take(lanes, np.where(eob, run, 0)) + (1 << np.where(eob, run, 0))
            block += np.where(eob, skipped, 0)
            k = np.where(eob, ss, k)
        done = k > se
        if done.any():
            block += done
            k[done] = ss
        going = block < end
        if not going.all():
            lanes, block, end, k = lanes[going], block[going], end[going], k[going]


def _decode_ac_refine(bits, lookup, order, table, first, lengths, ss, se, al, flat) -> None:  # noqa: ANN001
    """A lane reads a symbol when its last one is used up; then it goes one coefficient on, or to the block's end in an end-of-band run."""
    lanes = np.flatnonzero(lengths > 0)
    block = first[lanes].copy()
    end = block + lengths[lanes]
    k = np.full(len(lanes), ss)
    zeros = np.full(len(lanes), -1)  # zeros left to pass before the new value; -1: a symbol is due
    new = np.zeros(len(lanes), np.int64)
    rest = np.zeros(len(lanes), np.int64)  # blocks of an end-of-band run, this one included
    one = np.int64(1) << al
    column = np.arange(64)
    while len(lanes):
        due = np.flatnonzero((zeros < 0) & (rest == 0))
        if len(due):
            symbol = _symbols(bits, lookup, lanes[due], table[block[due]])
            run, size = symbol >> 4, symbol & 15
            eob = (size == 0) & (run < 15)
            got = bits.take(lanes[due], np.where(eob, run, (size > 0).astype(np.int64)))
            rest[due] = np.where(eob, got + (1 << np.where(eob, run, 0)), 0)
            zeros[due] = np.where(eob, -1, run)
            new[due] = np.where(size > 0, np.where(got > 0, one, -one), 0)
        tail = np.flatnonzero(rest > 0)
        if len(tail):  # nothing but one more bit for what isn't zero
            rows = order[block[tail]]
            old = flat.reshape(-1, 64)[rows]
            has = (old != 0) & (column >= k[tail][:, None]) & (column <= se)
            nth = np.cumsum(has, axis=1)
            more = bits.single(lanes[tail][:, None], nth - 1) << al
            flat.reshape(-1, 64)[rows] = old + np.where(has, np.where(old > 0, more, -more), 0)
            bits.at[lanes[tail]] += nth[:, -1]
            rest[tail] -= 1
            block[tail] += 1
            k[tail] = ss
        step = np.flatnonzero(zeros >= 0)
        if len(step):
            at = order[block[step]] * 64 + k[step]
            old = flat[at]
            has = old != 0
            more = bits.take(lanes[step], has.astype(np.int64)) << al
            place = ~has & (zeros[step] == 0)
            flat[at] = np.where(has, old + np.where(old > 0, more, -more), np.where(place, new[step], 0))
            zeros[step] -= ~has
            k[step] += 1
            done = step[k[step] > se]
            zeros[done] = -1
            block[done] += 1
            k[done] = ss
        going = block < end
        if not going.all():
            lanes, block, end, k, zeros, new, rest = (x[going] for x in (lanes, block, end, k, zeros, new, rest))


def coefficients(pictures: list[Picture]) -> np.ndarray:
    """One array (blocks, 64) of the pictures' coefficients in zigzag order; Component.at says where."""
    n = 0
    for p in pictures:
        for c in p.components:
            c.at = n
            n += c.blocks
    out = np.zeros((n, 64), np.int64)
    for step in range(max((len(p.scans) for p in pictures), default=0)):  # scans of a file follow each other
        groups = defaultdict(list)
        for p in pictures:
            if step < len(p.scans):
                s = p.scans[step]
                groups[s.ss, s.se, s.ah, s.al].append((p, s))
        for group in groups.values():
            _decode_scans(group, out)
    return out


def pixels(pictures: list[Picture], values: np.ndarray) -> np.ndarray:
    """(blocks, 64) of 0..255: dequantised and inverse-transformed."""
    components = [(c, p.quant[c.quant]) for p in pictures for c in p.components]
    quant = np.repeat(np.array([q for _, q in components]), [c.blocks for c, _ in components], axis=0)
    # whole numbers below 2 ** 53 until they are divided, so no order of summing changes them
    return np.clip(np.rint(((values * quant).astype(np.float64) @ BASIS.T) / (1 << 13)) + 128, 0, 255).astype(np.uint8)


def rgb(picture: Picture, samples: np.ndarray) -> np.ndarray:
    """The tensor (height, width, 3) of uint8: planes put together, chroma upsampled to full resolution, JFIF's colours."""
    planes = []
    for c in picture.components:
        tall = c.blocks // c.wide
        plane = samples[c.at : c.at + c.blocks].reshape(tall, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, c.wide * 8)
        if (c.h, c.v) != (picture.hmax, picture.vmax):
            # the sample that covers each place; the ratio need not be whole
            plane = plane[(np.arange(picture.height) * c.v // picture.vmax)[:, None], np.arange(picture.width) * c.h // picture.hmax]
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=-1)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    y <<= 16
    y += 1 << 15
    cb -= 128
    cr -= 128
    colours = y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb  # 2 ** 16 times the factors
    return np.clip(np.stack(colours, axis=-1) >> 16, 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of JPEG files."""
    pictures = [parse(f) for f in files]
    samples = pixels(pictures, coefficients(pictures))
    return [rgb(p, samples) for p in pictures]


# --- the writer -----------------------------------------------------------------------------------

#: A value's lowest bit comes in a scan of its own, after all scans of what is above it.
LOW = 1
#: Tables of the writer as lengths and symbols: a DC difference of 8 bits, in 4 bits; an AC value of 7 bits, in 1
#: bit, so that each makes up a byte; the end of the band, in 1 bit.
DC_TABLE = bytes([0, 0, 0, 9, *[0] * 12, *range(9)])
AC_TABLE = bytes([1, 1, *[0] * 14, 7, 0])
END_TABLE = bytes([1, *[0] * 15, 0])


def _ac_values() -> np.ndarray:
    """Each byte as a coefficient of magnitude 128 to 255, the lower half of the bytes negative."""
    b = np.arange(256)
    return np.where(b >= 128, b, b - 255)


AC_VALUES = _ac_values()
BYTES = np.zeros(512, np.uint8)
BYTES[AC_VALUES + 256] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(bits: np.ndarray, nth: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Rows of bits as restart intervals: filled up with ones, a zero after each 255, markers in between.

    counts are the rows of each file, nth a row's number in its file.
    """
    fill = -bits.shape[1] % 8
    rows = np.packbits(np.pad(bits, ((0, 0), (0, fill)), constant_values=1) if fill else bits, axis=1)
    flat = np.empty((len(rows), rows.shape[1] + 2), np.uint8)
    flat[:, :-2], flat[:, -2], flat[:, -1] = rows, 0xFF, 0xD0 + nth % 8
    full = rows == 0xFF
    y, x = np.nonzero(full)
    data = np.insert(flat.ravel(), y * flat.shape[1] + x + 1, 0).tobytes()
    ends = np.cumsum(counts)
    sizes = np.cumsum(full.sum(axis=1) + flat.shape[1])[ends - 1]
    return [data[s : e - 2] for s, e in zip([0, *sizes.tolist()], sizes.tolist(), strict=False)]


def _bit_rows(values: np.ndarray, n: int) -> np.ndarray:
    """(rows, k) numbers as (rows, k * n) bits."""
    if n == 8:
        return np.unpackbits(values, axis=1)
    return ((values[..., None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).reshape(len(values), -1)


def _scan(components: list[int], table: int, ss: int, se: int, ah: int, al: int) -> bytes:
    parts = [x for c in components for x in (c + 1, table)]
    return _segment(0xDA, bytes([len(components), *parts, ss, se, ah << 4 | al]))


def write(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files whose coefficients are the payloads' bytes, 64 a block and 192 an MCU.

    A payload's length is a positive multiple of 192. Y, Cb and Cr have a third each in turns of 64.
    """
    sizes = [len(p) // 192 for p in payloads]
    if any(not n or len(p) % 192 for n, p in zip(sizes, payloads, strict=True)):
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    down = [-(-n // 4096) for n in sizes]
    across = [-(-n // d) for n, d in zip(sizes, down, strict=True)]
    counts = np.array([a * d for a, d in zip(across, down, strict=True)])
    padded = b"".join(p.ljust(192 * n, b"\0") for p, n in zip(payloads, counts.tolist(), strict=True))
    grid = np.frombuffer(padded, np.uint8).reshape(-1, 3, 64)
    nth = np.arange(len(grid)) - np.repeat(np.cumsum(counts) - counts, counts)
    dc = grid[:, :, 0].astype(np.int64) + 256  # 9 bits, of which the first scan has 8, after symbol 8 (binary 1000)
    values = AC_VALUES[grid[:, :, 1:]]
    high = np.abs(values) >> LOW
    coded = np.where(values < 0, 127 - high, high)
    low = np.pad(np.abs(values) & 1, ((0, 0), (0, 0), (1, 0))).astype(np.uint8)  # a zero bit ends the band, then a bit for each value
    scans = [
        (_scan([0, 1, 2], 0, 0, 0, 0, LOW), _bit_rows((8 << 8) | (dc >> LOW), 12)),
        (_scan([0, 1, 2], 0, 0, 0, LOW, 0), (dc & 1).astype(np.uint8)),
        *((_scan([c], 0, 1, 63, 0, LOW), _bit_rows(coded[:, c].astype(np.uint8), 8)) for c in range(3)),
        *((_scan([c], 1, 1, 63, LOW, 0), low[:, c]) for c in range(3)),
    ]
    streams = [(head, _coded(bits, nth, counts)) for head, bits in scans]
    tables = _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE + b"\x11" + END_TABLE) + _segment(0xDD, struct.pack(">H", 1))
    quant, parts = _segment(0xDB, bytes([0, *[1] * 64])), bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    return [
        b"".join(
            [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(p))), quant, _segment(0xC2, struct.pack(">BHHB", 8, 8 * d, 8 * a, 3) + parts), tables]
            + [x for head, of in streams for x in (head, of[i])]
            + [b"\xff\xd9"]
        )
        for i, (p, a, d) in enumerate(zip(payloads, across, down, strict=True))
    ]


def payload(picture: Picture, values: np.ndarray) -> bytes:
    """The bytes that write() stored."""
    (size,) = struct.unpack(">Q", picture.comment)
    parts = np.stack([values[c.at : c.at + c.blocks] for c in picture.components], axis=1)
    out = BYTES[np.where(np.arange(64) > 0, parts + 256, 0)]
    out[:, :, 0] = parts[:, :, 0] - 256
    return out.tobytes()[:size]
