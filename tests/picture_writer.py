"""JPEG pictures and locked PDF files for the tests, written after the public standards by other code than the reader's."""

import hashlib
import math
import re
import struct

import numpy as np

from quire.sources import crypt

ORDER = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
COSINES = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0xF0} | {r << 4 for r in range(15)})


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def dc(self, symbol):
        self.put(DC_SYMBOLS.index(symbol), 4)

    def ac(self, symbol):
        self.put(AC_SYMBOLS.index(symbol), 8)

    def number(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def done(self):
        text = "".join(self.text)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def planes_of(pixels, coded):
    p = pixels.astype(float)
    if pixels.shape[2] >= 3 and coded:
        r, g, b = (p[:, :, i] if pixels.shape[2] == 3 else 255 - p[:, :, i] for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        return [y, 128 + 0.564 * (b - y), 128 + 0.713 * (r - y)] + ([p[:, :, 3]] if pixels.shape[2] == 4 else [])
    return [p[:, :, i] for i in range(p.shape[2])]


def segment(mark, body):
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def jpeg(pixels, sampling=None, progressive=False, restart=0, adobe=None, coded=True, quant=1):
    """The picture of pixels (rows, columns, 1, 3 or 4); sampling gives (h, v) of each component."""
    height, width, n = pixels.shape
    sampling = sampling or [(1, 1)] * n
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks = []
    for plane, (h, v) in zip(planes_of(pixels, coded), sampling):
        full = np.pad(plane, ((0, my * 8 * vmax - height), (0, mx * 8 * hmax - width)), mode="edge")
        fy, fx = vmax // v, hmax // h
        small = full.reshape(full.shape[0] // fy, fy, full.shape[1] // fx, fx).mean(axis=(1, 3))
        grid = (small - 128).reshape(small.shape[0] // 8, 8, small.shape[1] // 8, 8).swapaxes(1, 2)
        values = np.rint(COSINES @ grid @ COSINES.T / quant).astype(int).reshape(*grid.shape[:2], 64)
        blocks.append(values)
    out = b"\xff\xd8" + (segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, adobe])) if adobe is not None else b"")
    out += segment(0xDB, b"\0" + bytes([quant] * 64))
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out += segment(0xC2 if progressive else 0xC0, frame)
    out += segment(0xC4, b"\0" + bytes([0, 0, 0, len(DC_SYMBOLS)] + [0] * 12) + bytes(DC_SYMBOLS)) + segment(0xC4, b"\x10" + bytes([0] * 7 + [len(AC_SYMBOLS)] + [0] * 8) + bytes(AC_SYMBOLS))
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))

    def scan(parts, low, high, bits, each):
        """One scan: each(bits, component, block, last values) for its blocks in order."""
        head = bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([low, high, bits])
        if len(parts) == 1:
            h, v = sampling[parts[0]]
            own_x, own_y = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
            units = [[(parts[0], y, x)] for y in range(own_y) for x in range(own_x)]
        else:
            units = [[(c, y * sampling[c][1] + j, x * sampling[c][0] + i) for c in parts for j in range(sampling[c][1]) for i in range(sampling[c][0])] for y in range(my) for x in range(mx)]
        step, body = restart or len(units), b""
        for k in range(0, len(units), step):
            sink, last = Bits(), [0] * n
            for unit in units[k : k + step]:
                for c, y, x in unit:
                    each(sink, c, blocks[c][y, x], last)
            body += (bytes([0xFF, 0xD0 + (k // step - 1) % 8]) if k else b"") + sink.done()
        return segment(0xDA, head) + body

    def ac_part(sink, block, low, high, shift):
        run = 0
        for k in range(low, high + 1):
            v = int(block[ORDER[k]])
            v = (abs(v) >> shift) * (1 if v > 0 else -1)
            if not v:
                run += 1
                continue
            while run > 15:
                sink.ac(0xF0)
                run -= 16
            sink.ac(run << 4 | abs(v).bit_length())
            sink.number(v)
            run = 0
        if run:
            sink.ac(0)

    def whole(sink, c, block, last):
        difference, last[c] = int(block[0]) - last[c], int(block[0])
        sink.dc(abs(difference).bit_length())
        sink.number(difference)
        ac_part(sink, block, 1, 63, 0)

    def dc_first(sink, c, block, last):
        value = int(block[0]) >> 1
        difference, last[c] = value - last[c], value
        sink.dc(abs(difference).bit_length())
        sink.number(difference)

    def refine(sink, c, block, last):
        values = [int(block[ORDER[k]]) for k in range(64)]
        end = max((k for k in range(1, 64) if abs(values[k]) == 1), default=0)
        run, held = 0, []
        for k in range(1, 64):
            size = abs(values[k])
            if not size:
                run += 1
                continue
            while run > 15 and k <= end:
                sink.ac(0xF0)
                for bit in held:
                    sink.put(bit, 1)
                run, held = run - 16, []
            if size > 1:
                held.append(size & 1)
                continue
            sink.ac(run << 4 | 1)
            sink.put(values[k] > 0, 1)
            for bit in held:
                sink.put(bit, 1)
            run, held = 0, []
        if run or held:
            sink.ac(0)
            for bit in held:
                sink.put(bit, 1)

    everything = list(range(n))
    if not progressive:
        return out + scan(everything, 0, 63, 0, whole) + b"\xff\xd9"
    out += scan(everything, 0, 0, 0x01, dc_first)
    for c in everything:
        out += scan([c], 1, 5, 0x01, lambda s, c, b, last: ac_part(s, b, 1, 5, 1)) + scan([c], 6, 63, 0x01, lambda s, c, b, last: ac_part(s, b, 6, 63, 1))
    out += scan(everything, 0, 0, 0x10, lambda s, c, b, last: s.put(int(b[0]) & 1, 1))
    for c in everything:
        out += scan([c], 1, 63, 0x10, refine)
    return out + b"\xff\xd9"


def locked(raw, method, user=b""):
    """A plain file of the writer with its streams and strings enciphered; objects are `N 0 obj`, lengths direct."""
    owner, permissions, file_id = bytes(range(32)), -44, b"0123456789abcdef"
    revision, size = {"RC4-40": (2, 5), "RC4-128": (3, 16), "AESV2": (4, 16), "AESV3": (6, 32)}[method]
    pad = (user + crypt.PAD)[:32]
    if method == "AESV3":
        key, salts = bytes(range(7, 39)), (b"saltsalt", b"keysalt!")
        u = crypt.hardened(user, salts[0]) + salts[0] + salts[1]
        ue = crypt.aes_cbc_encipher(crypt.hardened(user, salts[1]), key, bytes(16))
        rules = f"/V 5 /R 6 /Length 256 /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF /O <{owner.hex()}> /U <{u.hex()}> /UE <{ue.hex()}> /P {permissions}"
    else:
        key = hashlib.md5(pad + owner + struct.pack("<i", permissions) + file_id).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        if revision == 2:
            u = crypt.rc4(key, crypt.PAD)
        else:
            u = hashlib.md5(crypt.PAD + file_id).digest()
            for i in range(20):
                u = crypt.rc4(bytes(b ^ i for b in key), u)
            u += bytes(16)
        crypts = "/CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if method == "AESV2" else ""
        rules = f"/V {({2: 1, 3: 2, 4: 4})[revision]} /R {revision} /Length {8 * size} {crypts} /O <{owner.hex()}> /U <{u.hex()}> /P {permissions}"

    def hide(data, number):
        if method == "AESV3":
            own = key
        else:
            own = hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, size + 5)]
        if method.startswith("AES"):
            fill = 16 - len(data) % 16
            return b"startstartstart!" + crypt.aes_cbc_encipher(own, data + bytes([fill] * fill), b"startstartstart!")
        return crypt.rc4(own, data)

    out, places = bytearray(b"%PDF-1.7\n"), {}
    for m in re.finditer(rb"(\d+) 0 obj\n(.*?)\nendobj\n", raw, re.S):
        number, body = int(m[1]), m[2]
        head, mark, rest = body.partition(b"stream\n")
        head = re.sub(rb"\(([^()]*)\)", lambda s: b"<" + hide(s[1], number).hex().encode() + b">", head)
        if mark:
            length = int(re.search(rb"/Length (\d+)", head)[1])
            hidden = hide(rest[:length], number)
            body = re.sub(rb"/Length \d+", b"/Length %d" % len(hidden), head) + b"stream\n" + hidden + b"\nendstream"
        else:
            body = head
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    number = max(places) + 1
    places[number] = len(out)
    out += b"%d 0 obj\n<< /Filter /Standard %s >>\nendobj\n" % (number, rules.encode())
    at = len(out)
    trailer = re.search(rb"trailer\n<<(.*?)>>\n", raw, re.S)[1]
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (number + 1) + b"".join(b"%010d 00000 n \n" % places.get(i, 0) for i in range(1, number + 1))
    out += b"trailer\n<<%s /Encrypt %d 0 R /ID [<%s> <%s>] >>\nstartxref\n%d\n%%%%EOF\n" % (trailer, number, file_id.hex().encode(), file_id.hex().encode(), at)
    return bytes(out)
