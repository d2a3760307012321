"""The standard security handler of PDF files with the empty user password: RC4 and AES, after the public standard.

Tables of AES are made by its rules; blocks of a text are deciphered together in numpy.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np


class CryptError(ValueError):
    """The file needs a password or another handler."""


# fixed value: the padding of passwords in the file format
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[k] = b ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def _doubled(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _doubled(a), b >> 1
    return out


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    box = np.zeros(256, dtype=np.uint8)
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        value = 0x63
        for shift in range(5):
            value ^= (inverse << shift | inverse >> (8 - shift)) & 255
        box[x] = value
    back = np.zeros(256, dtype=np.uint8)
    back[box] = np.arange(256)
    return box, back


_BOX, _BACK = _boxes()
_BY = {n: np.array([_times(x, n) for x in range(256)], dtype=np.uint8) for n in (9, 11, 13, 14)}
_ROWS = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])
_ROWS_BACK = np.argsort(_ROWS)


def _schedule(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words, constant = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        word = list(words[-1])
        if i % n == 0:
            word = [int(_BOX[b]) for b in word[1:] + word[:1]]
            word[0] ^= constant
            constant = _doubled(constant)
        elif n > 6 and i % n == 4:
            word = [int(_BOX[b]) for b in word]
        words.append([a ^ b for a, b in zip(words[i - n], word)])
    return np.array(words, dtype=np.uint8).reshape(-1, 16)


def _mixed(state: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    columns = state.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for r in range(4):
        for k in range(4):
            out[:, :, r] ^= _BY[factors[(k - r) % 4]][columns[:, :, k]]
    return out.reshape(-1, 16)


def _decipher_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = _BACK[state[:, _ROWS_BACK]] ^ keys[k]
        if k:
            state = _mixed(state, (14, 11, 13, 9))
    return state


# for one block after another: by row of the state the mixed column that a byte gives, as a number of 32 bits
_SPREAD = [[sum(_times(int(_BOX[x]), f) << s for f, s in zip(factors, (24, 16, 8, 0))) for x in range(256)] for factors in ((2, 1, 1, 3), (3, 2, 1, 1), (1, 3, 2, 1), (1, 1, 3, 2))]
_LAST = [int(x) for x in _BOX]


def _encipher_block(keys: list[list[int]], state: list[int]) -> list[int]:
    """Four columns of 32 bits under the round keys."""
    t0, t1, t2, t3 = _SPREAD
    a, b, c, d = (x ^ k for x, k in zip(state, keys[0]))
    for k0, k1, k2, k3 in keys[1:-1]:
        a, b, c, d = (
            t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k0,
            t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k1,
            t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k2,
            t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k3,
        )
    box, s = _LAST, (a, b, c, d)
    return [(box[s[i] >> 24] << 24 | box[s[(i + 1) % 4] >> 16 & 255] << 16 | box[s[(i + 2) % 4] >> 8 & 255] << 8 | box[s[(i + 3) % 4] & 255]) ^ keys[-1][i] for i in range(4)]


def aes_cbc_decipher(key: bytes, data: bytes, start: bytes | None = None, padded: bool = True) -> bytes:
    """The text behind a start block (the data's first if none is given); broken lengths are cut to whole blocks."""
    data = data[: len(data) // 16 * 16]
    if start is None:
        start, data = data[:16], data[16:]
    if not data:
        return b""
    blocks = np.frombuffer(data, dtype=np.uint8).reshape(-1, 16)
    chain = np.vstack((np.frombuffer(start, dtype=np.uint8), blocks[:-1]))
    out = (_decipher_blocks(_schedule(key), blocks) ^ chain).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


def aes_cbc_encipher(key: bytes, data: bytes, start: bytes) -> bytes:
    """data, of whole blocks, without padding."""
    keys = [list(struct.unpack(">4I", row.tobytes())) for row in _schedule(key)]
    last, out = list(struct.unpack(">4I", start)), []
    for block in struct.iter_unpack(">4I", data):
        last = _encipher_block(keys, [x ^ y for x, y in zip(block, last)])
        out += last
    return struct.pack(f">{len(out)}I", *out)


def hardened(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hash of revision 6."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = aes_cbc_encipher(k[:16], 64 * (password + k + extra), k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Decipher:
    """Strings and streams of objects under a file key."""

    def __init__(self, key: bytes, strings: str, streams: str, metadata: bool) -> None:
        self.key, self.methods, self.metadata = key, (strings, streams), metadata

    def _plain(self, method: str, data: bytes, number: int, generation: int) -> bytes:
        if method == "Identity":
            return data
        if method == "AESV3":
            return aes_cbc_decipher(self.key, data)
        salt = b"sAlT" if method == "AESV2" else b""
        own = hashlib.md5(self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc_decipher(own, data) if method == "AESV2" else rc4(own, data)

    def string(self, data: bytes, number: int, generation: int) -> bytes:
        return self._plain(self.methods[0], data, number, generation)

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        return self._plain(self.methods[1], data, number, generation)


def unlock(rules: dict, first_id: bytes) -> Decipher:
    """The decipherer of a file for the empty user password; CryptError if it doesn't open."""
    version, revision = rules.get("V", 0), rules.get("R", 0)
    if rules.get("Filter") not in (None, "Standard") or version not in (1, 2, 4, 5):
        raise CryptError("unknown security handler")
    methods = ("V2", "V2")
    if version >= 4:
        named = {k: v.get("CFM", "None") for k, v in rules.get("CF", {}).items()}
        methods = tuple("Identity" if (name := rules.get(which, "Identity")) == "Identity" or named.get(name) == "None" else named[name] for which in ("StrF", "StmF"))
    metadata = rules.get("EncryptMetadata", True)
    user = rules["U"]
    if version == 5:
        check, salt, key_salt = user[:32], user[32:40], user[40:48]
        hashed = hardened if revision >= 6 else (lambda password, salt: hashlib.sha256(password + salt).digest())
        if hashed(b"", salt) != check:
            raise CryptError("a password is needed")
        return Decipher(aes_cbc_decipher(hashed(b"", key_salt), rules["UE"][:32], bytes(16), padded=False), *methods, metadata)
    size = 5 if version == 1 or revision == 2 else rules.get("Length", 128 if version == 4 else 40) // 8
    digest = hashlib.md5(PAD + rules["O"][:32] + (rules["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"\xff" * 4 if revision >= 4 and not metadata else b"")).digest()
    if revision >= 3:
        for _ in range(50):
            digest = hashlib.md5(digest[:size]).digest()
    key = digest[:size]
    if revision == 2:
        fits = rc4(key, PAD) == user[:32]
    else:
        told = rc4(key, hashlib.md5(PAD + first_id).digest())
        for i in range(1, 20):
            told = rc4(bytes(b ^ i for b in key), told)
        fits = told == user[:16]
    if not fits:
        raise CryptError("a password is needed")
    return Decipher(key, *methods, metadata)
