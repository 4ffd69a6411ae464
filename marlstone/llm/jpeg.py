"""Progressive JPEG: lossless storage of bytes as quantised coefficients, and a decoder to coefficients and RGB.

Bytes are the format's units, coefficients: byte b is stored as b when it is 128 or more and as b - 255 otherwise, so every
coefficient has eight magnitude bits. Scans go by spectral selection (the first coefficient; 1 to 5; 6 to 63) and
successive approximation (all but the lowest bit; then that bit). The Huffman tables are chosen so that each coefficient
takes equally many bits, which numpy reads at once; the decoder reads any other progressive baseline-sized stream too.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np

#: Row-major place of each coefficient in zigzag order.
ZIGZAG = np.array(
    sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))), dtype=np.intp
)
BLOCK_BYTES = 64
#: Blocks of an MCU: four of luma, one of each chroma.
SLOTS = 6
BANDS = ((1, 5), (6, 63))
MARK = b"payload "


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for n in range(1, 17) for s in by_length.get(n, [])))


#: Code lengths by size of a first-coefficient difference: length and size make 16 bits.
DC_LENGTHS = {16 - s: [s] for s in range(10)}


def _codes(by_length: dict[int, list[int]]) -> dict[tuple[int, int], int]:
    """Canonical codes: (length, code) to symbol."""
    out, code = {}, 0
    for n in range(1, 17):
        for s in by_length.get(n, []):
            out[n, code] = s
            code += 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of every difference (offset by 512), and the difference of every 16 bits."""
    back = np.zeros(65_536, dtype=np.int16)
    words = np.zeros(1024, dtype=np.uint16)
    for (_, code), s in _codes(DC_LENGTHS).items():
        for extra in range(1 << s):
            d = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            word = code << s | extra
            back[word] = d
            if abs(d) < 512:
                words[d + 512] = word
    return words, back


def _stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + _stuff(data)


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of MCUs that hold so many blocks."""
    mcus = max(1, -(-blocks // SLOTS))
    columns = min(4095, math.isqrt(mcus - 1) + 1)
    return -(-mcus // columns), columns


def _planes(blocks: np.ndarray, rows: int, columns: int) -> list[np.ndarray]:
    """Blocks (n, 64) in MCU order as raster-ordered blocks of the three components."""
    mcu = blocks.reshape(rows, columns, SLOTS, 64)
    luma = mcu[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [luma, mcu[:, :, 4].reshape(-1, 64), mcu[:, :, 5].reshape(-1, 64)]


def _mcu_order(planes: list[np.ndarray], rows: int, columns: int) -> np.ndarray:
    luma = planes[0].reshape(rows, 2, columns, 2, -1).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, -1)
    chroma = [p.reshape(rows, columns, 1, -1) for p in planes[1:3]]
    return np.concatenate([luma, *chroma], axis=2).reshape(rows * columns * SLOTS, -1)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload``, a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK_BYTES:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    rows, columns = grid(len(payload) // BLOCK_BYTES)
    if rows > 4095:
        raise ValueError("the payload is too large for one image")
    room = rows * columns * SLOTS * BLOCK_BYTES
    data = np.frombuffer(payload + bytes(room - len(payload)), dtype=np.uint8).astype(np.int16)
    values = np.where(data >= 128, data, data - 255).reshape(-1, 64)
    planes = _planes(values, rows, columns)
    out = [
        b"\xff\xd8",
        _segment(0xFE, MARK + str(len(payload)).encode()),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0x00, DC_LENGTHS),
        _table(0x10, {1: [0x07]}),
    ]
    # First coefficients less their lowest bit, as differences within each component in MCU order.
    high = values[:, 0] >> 1
    slots = high.reshape(-1, SLOTS)
    previous = np.zeros_like(slots)
    previous[:, 1:4] = slots[:, 0:3]
    previous[1:, 0] = slots[:-1, 3]
    previous[1:, 4:] = slots[:-1, 4:]
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _dc_words()[0][(slots - previous).ravel() + 512].astype(">u2").tobytes()))
    for c, plane in enumerate(planes):
        for first, last in BANDS:
            part = plane[:, first : last + 1]
            size = np.abs(part) >> 1
            out.append(_scan([c + 1], first, last, 0, 1, np.where(part > 0, size, 127 - size).astype(np.uint8).tobytes()))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, _bits((values[:, 0] & 1).astype(np.uint8))))
    out.append(_table(0x10, {1: [0x00]}))
    for c, plane in enumerate(planes):
        bits = np.abs(plane).astype(np.uint8) & 1
        bits[:, 0] = 0  # the code that no further coefficient begins in this block
        out.append(_scan([c + 1], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes()))
    return b"".join(out) + b"\xff\xd9"


def _bits(bits: np.ndarray) -> bytes:
    """Bits packed to bytes, the last filled with ones."""
    return np.packbits(np.r_[bits, np.ones(-len(bits) % 8, dtype=np.uint8)]).tobytes()


# ---- reading


class Component:
    def __init__(self, horizontal: int, vertical: int, table: int):
        self.h, self.v, self.table = horizontal, vertical, table
        self.rows = self.columns = self.shown_rows = self.shown_columns = 0
        self.values = np.zeros((0, 64), dtype=np.int32)
        self.dense = 64  # coefficients from here on have not been sent yet or may be 0


class Bits:
    """Bits of an entropy-coded segment, one by one."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            byte = self.at >> 3
            bit = self.data[byte] >> (7 - (self.at & 7)) & 1 if byte < len(self.data) else 1
            out, self.at = out << 1 | bit, self.at + 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Image:
    """Coefficients (zigzag order) of each component, gathered over the scans of a progressive JPEG."""

    def __init__(self, media: bytes):
        self.width = self.height = self.restart = 0
        self.components: dict[int, Component] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.comment = b""
        if media[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while at + 4 <= len(media):
            marker = media[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", media, at + 2)[0]
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDA:
                at = self._scan(media, at, body)
            else:
                self._header(marker, body)

    def _header(self, marker: int, body: bytes) -> None:
        if marker == 0xFE:
            self.comment = body
        elif marker == 0xDD:
            self.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                self.quantisers[k] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols, lengths, i = body[17 : 17 + sum(counts)], {}, 0
                for n, k in enumerate(counts, 1):
                    lengths[n] = list(symbols[i : i + k])
                    i += k
                self.codes[body[0]] = _codes(lengths)
                body = body[17 + i :]
        elif marker == 0xC2:
            precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("samples must have 8 bits")
            for k in range(n):
                i, hv, table = body[6 + 3 * k : 9 + 3 * k]
                self.components[i] = Component(hv >> 4, hv & 15, table)
            self.most_h = max(c.h for c in self.components.values())
            self.most_v = max(c.v for c in self.components.values())
            self.mcu_rows, self.mcu_columns = -(-self.height // (8 * self.most_v)), -(-self.width // (8 * self.most_h))
            for c in self.components.values():
                c.rows, c.columns = self.mcu_rows * c.v, self.mcu_columns * c.h
                c.shown_rows = -(-(-(-self.height * c.v // self.most_v)) // 8)
                c.shown_columns = -(-(-(-self.width * c.h // self.most_h)) // 8)
                c.values = np.zeros((c.rows * c.columns, 64), dtype=np.int16)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("no progressive Huffman JPEG")

    def _scan(self, media: bytes, at: int, body: bytes) -> int:
        n = body[0]
        parts = [(self.components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
        first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
        high, low = approximation >> 4, approximation & 15
        end, pieces = at, []
        while True:  # to the next marker that is no stuffing; restarts split the segment
            end = media.find(b"\xff", end)
            if end < 0 or end + 1 >= len(media):
                end = len(media)
                break
            if media[end + 1] == 0:
                end += 2
            elif 0xD0 <= media[end + 1] <= 0xD7:
                pieces.append(media[at:end])
                at = end = end + 2
            else:
                break
        pieces.append(media[at:end])
        data = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
        if len(data) > 1 or not self._scan_at_once(parts, first, last, high, low, data[0]):
            self._scan_bit_by_bit(parts, first, last, high, low, data)
        return end

    def _raster(self, c: Component, alone: bool) -> np.ndarray:
        """Block numbers in the order in which a scan of one component has them."""
        every = np.arange(c.rows * c.columns).reshape(c.rows, c.columns)
        return every[: c.shown_rows, : c.shown_columns].ravel() if alone else every.ravel()

    def _mcus(self, parts: list) -> list[tuple[int, np.ndarray]]:
        """Of an interleaved scan: for each block of an MCU, the part's number and the block numbers over all MCUs."""
        out = []
        for p, (c, _) in enumerate(parts):
            every = np.arange(c.rows * c.columns).reshape(self.mcu_rows, c.v, self.mcu_columns, c.h)
            out += [(p, every[:, y, :, x].ravel()) for y in range(c.v) for x in range(c.h)]
        return out

    def _scan_at_once(self, parts: list, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Reads the scan if all its units have the same number of bits; else returns False."""
        if first == 0:
            slots = self._mcus(parts) if len(parts) > 1 else [(0, self._raster(parts[0][0], True))]
            n = sum(len(s[1]) for s in slots)
            if high:
                got = np.unpackbits(np.frombuffer(data, dtype=np.uint8))[:n].astype(np.int16)
                if len(got) < n:
                    return False
                got = got.reshape(-1, len(slots))
                for k, (p, blocks) in enumerate(slots):
                    parts[p][0].values[blocks, 0] |= got[:, k] << low
                return True
            tables = [self.codes[t >> 4] for _, t in parts]
            if any(len(t) != len(tables[0]) or any(length + s != 16 for (length, _), s in t.items()) for t in tables) or len(data) < 2 * n:
                return False
            if tables[0] != _codes(DC_LENGTHS) or any(t != tables[0] for t in tables):
                return False
            got = _dc_words()[1][np.frombuffer(data[: 2 * n], dtype=">u2")].astype(np.int32).reshape(-1, len(slots))
            for p, (c, _) in enumerate(parts):
                own = [k for k, s in enumerate(slots) if s[0] == p]
                total = np.cumsum(got[:, own].ravel()).reshape(-1, len(own))
                for j, k in enumerate(own):
                    c.values[slots[k][1], 0] = total[:, j] << low
            return True
        c, t = parts[0]
        codes, blocks, n = self.codes[16 | (t & 15)], self._raster(parts[0][0], True), last - first + 1
        if len(codes) != 1:
            return False
        (length, _), symbol = next(iter(codes.items()))
        if high == 0 and symbol >> 4 == 0 and length == 1 and symbol == 7 and len(data) >= n * len(blocks):
            raw = np.frombuffer(data[: n * len(blocks)], dtype=np.uint8).reshape(-1, n).astype(np.int16)
            c.values[blocks, first : last + 1] = np.where(raw >= 64, raw, raw - 127) << low
            return True
        if high and symbol == 0 and length == 1 and (1 + n) % 8 == 0 and len(data) >= (1 + n) // 8 * len(blocks):
            part = c.values[blocks, first : last + 1]
            if not part.all():
                return False
            bits = np.unpackbits(np.frombuffer(data[: (1 + n) // 8 * len(blocks)], dtype=np.uint8)).reshape(-1, 1 + n)[:, 1:].astype(np.int16)
            c.values[blocks, first : last + 1] = part + np.where(part > 0, bits, -bits) * (1 << low)
            return True
        return False

    def _scan_bit_by_bit(self, parts: list, first: int, last: int, high: int, low: int, data: list[bytes]) -> None:
        if len(parts) > 1:
            units = [list(x) for x in zip(*([(p, int(b)) for b in blocks] for p, blocks in self._mcus(parts)), strict=True)]
        else:
            units = [[(0, int(b))] for b in self._raster(parts[0][0], True)]
        step = self.restart or len(units)
        for k, piece in enumerate(data):
            bits, before, self._run = Bits(piece), [0] * len(parts), 0
            for unit in units[k * step : (k + 1) * step]:
                for p, block in unit:
                    c, t = parts[p]
                    if first == 0 and high == 0:
                        before[p] += bits.value(bits.symbol(self.codes[t >> 4]))
                        c.values[block, 0] = before[p] << low
                    elif first == 0:
                        c.values[block, 0] |= bits.take(1) << low
                    elif high == 0:
                        self._first_pass(bits, c.values[block], self.codes[16 | (t & 15)], first, last, low)
                    else:
                        self._refine(bits, c.values[block], self.codes[16 | (t & 15)], first, last, low)

    def _first_pass(self, bits: Bits, block: np.ndarray, codes: dict, first: int, last: int, low: int) -> None:
        if self._run:
            self._run -= 1
            return
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(codes), 16)
            if size:
                k += run
                block[k] = bits.value(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self._run = (1 << run) + bits.take(run) - 1
                return

    def _refine(self, bits: Bits, block: np.ndarray, codes: dict, first: int, last: int, low: int) -> None:
        k, one = first, 1 << low

        def correct(k: int) -> None:
            if bits.take(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        while k <= last and not self._run:
            run, size = divmod(bits.symbol(codes), 16)
            fresh = 0
            if size:
                fresh = one if bits.take(1) else -one
            elif run < 15:
                self._run = (1 << run) + bits.take(run)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif run == 0:
                    if fresh:
                        block[k] = fresh
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if self._run:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            self._run -= 1

    def samples(self, c: Component, top: int, rows: int) -> np.ndarray:
        """Samples (rows * 8, width) of block rows ``top`` and following: the inverse transform, without the level shift."""
        own = c.values[top * c.columns : (top + rows) * c.columns]
        pixels = (own.astype(np.float32) * self.quantisers[c.table]) @ inverse_transform()
        return pixels.reshape(rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, c.columns * 8)

    def rgb_strips(self, mcu_rows: int = 64):
        """The image as (rows, width, 3) uint8 strips from the top; chroma is upsampled to full resolution."""
        for top in range(0, self.mcu_rows, mcu_rows):
            n = min(mcu_rows, self.mcu_rows - top)
            planes = []
            for c in self.components.values():
                p = self.samples(c, top * c.v, n * c.v)
                if c.v != self.most_v:
                    p = p.repeat(self.most_v // c.v, axis=0)
                if c.h != self.most_h:
                    p = p.repeat(self.most_h // c.h, axis=1)
                planes.append(p)
            height = min(n * 8 * self.most_v, self.height - top * 8 * self.most_v)
            y = planes[0] + np.float32(128)
            if len(planes) == 1:
                rgb = np.repeat(y[:, :, None], 3, axis=2)
            else:
                cb, cr = planes[1], planes[2]
                rgb = np.empty((*y.shape, 3), dtype=np.float32)
                rgb[..., 0] = y + np.float32(1.402) * cr
                rgb[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
                rgb[..., 2] = y + np.float32(1.772) * cb
            np.clip(rgb, 0, 255, out=rgb)
            yield np.rint(rgb[:height, : self.width]).astype(np.uint8)

    def rgb(self) -> np.ndarray:
        return np.concatenate(list(self.rgb_strips()), axis=0)

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        planes = [c.values for c in self.components.values()]
        values = _mcu_order(planes, self.mcu_rows, self.mcu_columns)
        if not self.comment.startswith(MARK):
            raise ValueError("the image holds no payload")
        data = np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()
        return data[: int(self.comment[len(MARK) :])]


@lru_cache(maxsize=1)
def inverse_transform() -> np.ndarray:
    """Matrix from the 64 coefficients in zigzag order to the 64 samples of a block."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis).T[ZIGZAG].astype(np.float32)
