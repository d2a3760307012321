"""Plain PDF files of positioned text, so that the decoder can be driven by rows of a table.

One composite font of two-byte codes serves a file; its ToUnicode map names the file's characters, so any text
comes back as it was written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np


class _Told(dict):
    """Numbers as they are written, each made once."""

    def __missing__(self, value: float) -> str:
        self[value] = told = f"{value:.10g}"
        return told


def write(pages: Iterable[Iterable[tuple[str, float, float]]]) -> bytes:
    """A file with a page for each list of (text, x, y)."""
    given = [list(page) for page in pages]
    joined = "".join([text for page in given for text, _, _ in page])
    used = sorted(set(joined))
    if len(used) > 65_000:
        raise ValueError("too many different characters for one font")
    # all texts are coded at once, four digits a character
    codes = np.empty(ord(used[-1]) + 1 if used else 0, dtype=">u2")
    codes[list(map(ord, used))] = np.arange(1, len(used) + 1)
    digits = codes[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")].tobytes().hex()
    contents, told, at = [], _Told(), 0
    for page in given:
        shown = []
        for text, x, y in page:
            end = at + 4 * len(text)
            shown.append(f"1 0 0 1 {told[x]} {told[y]} Tm <{digits[at:end]}> Tj")
            at = end
        contents.append(f"BT /F1 1 Tf {' '.join(shown)} ET".encode() if shown else b"")
    names = [f"<{code:04X}> <{c.encode('utf-16-be').hex().upper()}>" for code, c in enumerate(used, 1)]
    chunks = [names[i : i + 100] for i in range(0, len(names), 100)]
    mapping = " ".join(f"{len(chunk)} beginbfchar {' '.join(chunk)} endbfchar" for chunk in chunks)
    kids = " ".join(f"{7 + 2 * i} 0 R" for i in range(len(contents)))

    def stream(raw: bytes) -> bytes:
        packed = zlib.compress(raw, 4)  # a small file then takes a block less, at little cost
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"

    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(contents)} /Kids [{kids}] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>",
        stream(mapping.encode()),
    ]
    for i, content in enumerate(contents):
        bodies += [stream(content), f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode()]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for number, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))
