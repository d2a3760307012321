"""Small PDF files for the tests: plain or packed in object and cross-reference streams."""

import zlib


def text_page(*placed, extra=""):
    """Content that shows (x, y, text) triples."""
    escaped = [(x, y, t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")) for x, y, t in placed]
    return "BT /F1 12 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj" for x, y, t in escaped) + " ET " + extra


def build(pages, images=None, info=None, xmp=None, packed=False, compress=True, broken_xref=False, fonts=None):
    """A file with one page for each content string; images: name -> (dict entries, raw bytes)."""
    bodies = {}

    def stream(entries, raw):
        if compress and "/Filter" not in entries:
            raw, entries = zlib.compress(raw), entries + " /Filter /FlateDecode"
        return f"<< {entries} /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream"

    number = 3
    bodies[3] = (fonts or "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>").encode()
    named = []
    for name, (entries, raw) in (images or {}).items():
        number += 1
        bodies[number] = stream(f"/Type /XObject /Subtype /Image {entries}", raw)
        named.append(f"/{name} {number} 0 R")
    kids = []
    for content in pages:
        number += 2
        bodies[number - 1] = stream("", content.encode("latin-1")) if content is not None else b"<< /Length 3 /Filter /JBIG2Decode >>\nstream\nabc\nendstream"
        bodies[number] = f"<< /Type /Page /Parent 2 0 R /Contents {number - 1} 0 R >>".encode()
        kids.append(f"{number} 0 R")
    catalog = "/Type /Catalog /Pages 2 0 R"
    if xmp:
        number += 1
        bodies[number] = stream("/Type /Metadata /Subtype /XML", xmp.encode())
        catalog += f" /Metadata {number} 0 R"
    bodies[1] = f"<< {catalog} >>".encode()
    bodies[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /Resources << /Font << /F1 3 0 R >> /XObject << {' '.join(named)} >> >> >>".encode()
    trailer = "/Root 1 0 R"
    if info:
        number += 1
        bodies[number] = ("<< " + " ".join(f"/{k} ({v})" for k, v in info.items()) + " >>").encode("latin-1")
        trailer += f" /Info {number} 0 R"
    out, places = bytearray(b"%PDF-1.7\n"), {}
    inner = [n for n in sorted(bodies) if packed and b"stream" not in bodies[n]]
    for n in sorted(set(bodies) - set(inner)):
        places[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n".encode() + bodies[n] + b"\nendobj\n"
    if packed:
        number += 1
        head, body = "", b""
        for i, n in enumerate(inner):
            head += f"{n} {len(body)} "
            body += bodies[n] + b" "
            places[n] = (2, number, i)
        places[number] = (1, len(out), 0)
        out += f"{number} 0 obj\n".encode() + stream(f"/Type /ObjStm /N {len(inner)} /First {len(head)}", head.encode() + body) + b"\nendobj\n"
        number += 1
        at = len(out)
        places[number] = (1, at, 0)
        rows = b"\0" * 7 + b"".join(bytes([places[n][0]]) + places[n][1].to_bytes(4, "big") + places[n][2].to_bytes(2, "big") for n in range(1, number + 1))
        predicted = b"".join(b"\x02" + bytes(c - a & 255 for c, a in zip(rows[i : i + 7], rows[i - 7 : i] if i else bytes(7))) for i in range(0, len(rows), 7))
        out += f"{number} 0 obj\n<< /Type /XRef /Size {number + 1} /W [1 4 2] {trailer} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length {len(zlib.compress(predicted))} >>\nstream\n".encode() + zlib.compress(predicted) + b"\nendstream\nendobj\n"
    else:
        at = len(out)
        out += f"xref\n0 {number + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n][1]:010d} 00000 n \n".encode() for n in range(1, number + 1))
        out += f"trailer\n<< /Size {number + 1} {trailer} >>\n".encode()
    out += f"startxref\n{at + (7 if broken_xref else 0)}\n%%EOF\n".encode()
    return bytes(out)
