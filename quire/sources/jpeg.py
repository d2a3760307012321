"""Baseline and progressive JPEG pictures (Huffman-coded, 8 bits a sample) to samples, after the public standard.

Coefficients are read in Python, all blocks of a component are transformed at once in numpy, and components of
lower resolution are spread by repetition. Arithmetic coding, lossless and 12-bit pictures raise JpegError.
"""

from __future__ import annotations

import numpy as np


class JpegError(ValueError):
    """The picture can't be decoded."""


def _zigzag() -> list[int]:
    """Row-major place of each coefficient: along the diagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = _zigzag()
_BASIS = np.array([[(0.5 if u else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of one entropy-coded stretch without its stuffing; zeros follow its end."""

    def __init__(self, raw: bytes) -> None:
        self.data, self.at = raw.replace(b"\xff\x00", b"\xff") + bytes(16), 0
        self.end = 8 * (len(self.data) - 8)

    def take(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        if at > self.end:
            raise JpegError("the picture's data ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big") >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        if at > self.end:
            raise JpegError("the picture's data ends early")
        found = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
        if not found:
            raise JpegError("unknown code")
        self.at = at + (found >> 8)
        return found & 255

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


class _Component:
    def __init__(self, key: int, h: int, v: int, quant: int) -> None:
        self.key, self.h, self.v, self.quant = key, h, v, quant
        self.dc = self.ac = 0
        self.before = 0


class Picture:
    """A decoded picture: width, height, samples (rows, columns, components) and the Adobe transform if one is told."""

    def __init__(self, data: bytes) -> None:
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, list[int]] = {}
        self.parts: list[_Component] = []
        self.transform: int | None = None
        self.interval = self.width = self.height = 0
        self.progressive = False
        if data[:2] != b"\xff\xd8":
            raise JpegError("no picture")
        try:
            self._read(data)
            self.samples = self._samples()
        except (IndexError, KeyError, AttributeError) as e:
            raise JpegError("the picture is damaged") from e

    def _read(self, data: bytes) -> None:
        at, scans = 2, 0
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if mark == 0xDB:
                self._quants(body)
            elif mark == 0xC4:
                self._codes(body)
            elif mark in (0xC0, 0xC1, 0xC2):
                self._frame(body, mark == 0xC2)
            elif mark in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise JpegError("this coding has no decoder")
            elif mark == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.transform = body[11]
            elif mark == 0xDA:
                at = self._scan(body, data, at)
                scans += 1
        if not scans:
            raise JpegError("no picture data")

    def _quants(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, key = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            values = np.frombuffer(body[at + 1 : at + 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
            table = np.zeros(64, dtype=np.int64)
            table[ZIGZAG] = values
            self.quants[key] = table
            at += 1 + n

    def _codes(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            key, counts = body[at], body[at + 1 : at + 17]
            symbols, at = body[at + 17 : at + 17 + sum(counts)], at + 17 + sum(counts)
            table, code, taken = [0] * 65536, 0, 0
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    low = code << (16 - length)
                    table[low : low + (1 << (16 - length))] = [length << 8 | symbols[taken]] * (1 << (16 - length))
                    code, taken = code + 1, taken + 1
                code <<= 1
            self.tables[key] = table

    def _frame(self, body: bytes, progressive: bool) -> None:
        if body[0] != 8:
            raise JpegError("samples of this width have no decoder")
        self.progressive = progressive
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        self.parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        if not self.parts or not self.width or not self.height or any(not c.h or not c.v for c in self.parts):
            raise JpegError("no size")
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.parts:
            c.columns, c.rows = self.mcus_x * c.h, self.mcus_y * c.v
            # blocks that a scan of this component alone has
            c.own_x = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.own_y = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.values = [0] * (64 * c.columns * c.rows)

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        if not self.parts:
            raise JpegError("no frame")
        n = body[0]
        chosen = []
        for i in range(n):
            part = next((c for c in self.parts if c.key == body[1 + 2 * i]), None)
            if part is None:
                raise JpegError("unknown component")
            part.dc, part.ac = body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)
            chosen.append(part)
        low, high, bits = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
        if not self.progressive:
            low, high, bits = 0, 63, 0
        # the stretches of the scan, between restart marks
        stretches, begin = [], at
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                at = len(data)
                stretches.append(data[begin:at])
                break
            if data[at + 1] == 0:
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                stretches.append(data[begin:at])
                at = begin = at + 2
            elif data[at + 1] == 0xFF:
                at += 1
            else:
                stretches.append(data[begin:at])
                break
        if n == 1:
            c = chosen[0]
            units = [[(c, 64 * (y * c.columns + x))] for y in range(c.own_y) for x in range(c.own_x)]
        else:
            units = [[(c, 64 * ((my * c.v + y) * c.columns + mx * c.h + x)) for c in chosen for y in range(c.v) for x in range(c.h)] for my in range(self.mcus_y) for mx in range(self.mcus_x)]
        step = self.interval or len(units)
        read = self._block if not self.progressive else (self._first if bits >> 4 == 0 else self._refined)
        for k, raw in enumerate(stretches):
            source = _Bits(raw)
            self.run = 0
            for c in chosen:
                c.before = 0
            try:
                for unit in units[k * step : (k + 1) * step]:
                    for c, place in unit:
                        read(source, c, place, low, high, bits & 15)
            except JpegError:
                if not any(any(c.values) for c in chosen):
                    raise
                # what a damaged stretch gave stays, as viewers do
        return at

    def _block(self, source: _Bits, c: _Component, place: int, low: int, high: int, bits: int) -> None:
        values, ac = c.values, self.tables[c.ac]
        c.before += source.signed(source.symbol(self.tables[c.dc]))
        values[place] = c.before
        k = 1
        while k < 64:
            rs = source.symbol(ac)
            size = rs & 15
            if not size:
                if rs != 0xF0:
                    return
                k += 16
                continue
            k += rs >> 4
            if k > 63:
                raise JpegError("too many coefficients")
            values[place + ZIGZAG[k]] = source.signed(size)
            k += 1

    def _first(self, source: _Bits, c: _Component, place: int, low: int, high: int, bits: int) -> None:
        values = c.values
        if low == 0:
            c.before += source.signed(source.symbol(self.tables[c.dc]))
            values[place] = c.before << bits
            return
        if self.run:
            self.run -= 1
            return
        k, ac = low, self.tables[c.ac]
        while k <= high:
            rs = source.symbol(ac)
            r, size = rs >> 4, rs & 15
            if not size:
                if r < 15:
                    self.run = (1 << r) - 1 + source.take(r)
                    return
                k += 16
                continue
            k += r
            if k > 63:
                raise JpegError("too many coefficients")
            values[place + ZIGZAG[k]] = source.signed(size) << bits
            k += 1

    def _refined(self, source: _Bits, c: _Component, place: int, low: int, high: int, bits: int) -> None:
        values, one = c.values, 1 << bits
        if low == 0:
            values[place] |= source.take(1) << bits
            return
        k, ac = low, self.tables[c.ac]

        def correct(at: int) -> None:
            if source.take(1) and not abs(values[at]) & one:
                values[at] += one if values[at] > 0 else -one

        if not self.run:
            while k <= high:
                rs = source.symbol(ac)
                r, new = rs >> 4, 0
                if rs & 15:
                    new = one if source.take(1) else -one
                elif r < 15:
                    self.run = (1 << r) + source.take(r)
                    break
                while k <= high:
                    at = place + ZIGZAG[k]
                    if values[at]:
                        correct(at)
                    elif r:
                        r -= 1
                    else:
                        if new:
                            values[at] = new
                        k += 1
                        break
                    k += 1
        if self.run:
            while k <= high:
                at = place + ZIGZAG[k]
                if values[at]:
                    correct(at)
                k += 1
            self.run -= 1

    def _samples(self) -> np.ndarray:
        planes = []
        for c in self.parts:
            if c.quant not in self.quants:
                raise JpegError("no quantisation table")
            blocks = (np.array(c.values, dtype=np.int64).reshape(-1, 64) * self.quants[c.quant]).reshape(-1, 8, 8)
            pixels = np.clip(np.rint(_BASIS.T @ blocks @ _BASIS) + 128, 0, 255).astype(np.uint8)
            plane = pixels.reshape(c.rows, c.columns, 8, 8).swapaxes(1, 2).reshape(8 * c.rows, 8 * c.columns)
            rows = np.arange(self.height) * c.v // self.vmax
            columns = np.arange(self.width) * c.h // self.hmax
            planes.append(plane[rows][:, columns])
        return np.stack(planes, axis=2)


def decode(data: bytes, transform: int | None = None) -> np.ndarray:
    """Samples (rows, columns, 1, 3 or 4): gray, RGB or CMYK. transform (1 or 0) tells whether colours are coded as
    luminance and differences where the picture itself doesn't."""
    picture = Picture(data)
    samples, n = picture.samples, len(picture.parts)
    told = picture.transform if picture.transform is not None else transform
    if n == 3:
        named = bytes(c.key for c in picture.parts) == b"RGB"
        coded = bool(told) if told is not None else not named
    else:
        coded = n == 4 and bool(told)
    if coded:
        y, cb, cr = (samples[:, :, i].astype(np.float64) for i in range(3))
        cb, cr = cb - 128, cr - 128
        colours = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)
        colours = np.clip(np.rint(colours), 0, 255).astype(np.uint8)
        samples = colours if n == 3 else np.concatenate((255 - colours, samples[:, :, 3:]), axis=2)
    if n not in (1, 3, 4):
        raise JpegError("this number of components has no decoder")
    return samples
