"""Pictures, masks, locked files and predefined encodings of the PDF reader."""

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pdf_writer import build, text_page  # noqa: E402
from picture_writer import jpeg, locked  # noqa: E402

from quire.sources import jpeg as reader  # noqa: E402
from quire.sources import pdf  # noqa: E402


def smooth(height, width, n):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([128 + 100 * np.sin((y * (i + 1) + x * (3 - i)) / 19 + i) for i in range(n)], axis=2).round().astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize(("n", "sampling", "restart"), [(1, None, 0), (3, None, 0), (3, None, 3), (3, [(2, 2), (1, 1), (1, 1)], 0), (3, [(2, 1), (1, 1), (1, 1)], 2), (1, [(2, 2)], 0)])
def test_pictures_come_back(n, sampling, restart, progressive):
    pixels = smooth(37, 45, n)
    got = reader.decode(jpeg(pixels, sampling, progressive, restart))
    off = np.abs(got.astype(int) - pixels)
    assert got.shape == pixels.shape and off.mean() < (1 if n == 1 or not sampling else 4) and off.max() <= (2 if n == 1 or not sampling else 40)


def test_noise_needs_every_coefficient():
    pixels = np.random.default_rng(5).integers(0, 256, size=(24, 40, 1)).astype(np.uint8)
    for progressive in (False, True):
        assert np.abs(reader.decode(jpeg(pixels, progressive=progressive)).astype(int) - pixels).max() <= 2


def test_colours_as_told():
    pixels = smooth(16, 16, 3)
    assert np.abs(reader.decode(jpeg(pixels, coded=False, adobe=0)).astype(int) - pixels).max() <= 2
    assert np.abs(reader.decode(jpeg(pixels, coded=False), transform=0).astype(int) - pixels).max() <= 2
    inks = smooth(16, 16, 4)
    assert np.abs(reader.decode(jpeg(inks, coded=False, adobe=0)).astype(int) - inks).max() <= 2
    assert np.abs(reader.decode(jpeg(inks, coded=True, adobe=2)).astype(int) - inks).max() <= 3


def test_damaged_pictures_are_refused_or_partial():
    whole = jpeg(smooth(24, 24, 3))
    for cut in range(2, len(whole), 61):
        try:
            assert reader.decode(whole[:cut]).shape == (24, 24, 3)
        except ValueError:
            pass
    for raw in (b"", b"\xff\xd8", b"\xff\xd8\xff\xd9"):
        with pytest.raises(reader.JpegError):
            reader.decode(raw)


def objects(images):
    paint = " ".join(f"/{n} Do" for n in images)
    return pdf.page_layout(pdf.Document(build([paint], images)), 1, with_images=True).images


def test_images_of_a_page():
    pixels = smooth(20, 12, 3)
    raw = jpeg(pixels)
    ink = bytes([0, 255, 0, 0, 10, 20, 30, 255])
    found = objects(
        {
            "Photo": ("/Width 12 /Height 20 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode", raw),
            "Twice": ("/Width 12 /Height 20 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter [/FlateDecode /DCTDecode]", zlib.compress(raw)),
            "Ink": ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK", ink),
            "Turned": ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Decode [1 0]", b"\x00\x40"),
            "Key": ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Mask [10 20]", b"\x0f\x40"),
            "Four": ("/Width 3 /Height 1 /BitsPerComponent 4 /ColorSpace /DeviceGray", b"\x0f\x50"),
        }
    )
    assert found["Photo"]["kind"] == 2 and np.abs(np.frombuffer(found["Photo"]["data"], np.uint8).reshape(20, 12, 3).astype(int) - pixels).max() <= 2
    assert found["Twice"]["data"] == found["Photo"]["data"]
    assert (found["Ink"]["kind"], found["Ink"]["data"]) == (2, bytes([255, 0, 255, 0, 0, 0]))
    assert found["Turned"]["data"] == b"\xff\xbf"
    assert (found["Key"]["kind"], found["Key"]["data"]) == (3, bytes([15, 15, 15, 0, 64, 64, 64, 255]))
    assert found["Four"]["data"] == bytes([0, 255, 85])


def test_soft_masks_and_stencils():
    images = {
        "Soft": ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x80\x10"),
        "Hard": ("/Width 2 /Height 2 /BitsPerComponent 1 /ImageMask true", b"\x80\x00"),
        "A": ("/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /SMask 4 0 R", b"abcdef"),
        "B": ("/Width 4 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Mask 5 0 R", b"wxyz"),
    }
    found = objects(images)
    assert (found["A"]["kind"], found["A"]["data"]) == (3, b"abc\x80def\x10")
    assert (found["B"]["kind"], found["B"]["data"]) == (3, b"www\x00xxx\x00yyy\xffzzz\xff")


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AESV2", "AESV3"])
def test_files_locked_with_the_empty_password_open(method):
    plain = build([text_page((10, 700, "Hello")), text_page((0, 5, "again"))], info={"Title": "Secret title"})
    doc = pdf.Document(locked(plain, method))
    assert [pdf.page_layout(doc, n).runs[0][0] for n in (1, 2)] == ["Hello", "again"]
    assert doc.info()["Title"] == "Secret title"
    with pytest.raises(pdf.PdfError, match="password"):
        pdf.Document(locked(plain, method, user=b"other"))


@pytest.mark.parametrize(("encoding", "codec"), [("UniJIS-UTF16-H", "utf-16-be"), ("90ms-RKSJ-H", "cp932"), ("GBK-EUC-H", "gbk"), ("ETen-B5-V", "big5"), ("KSCms-UHC-H", "cp949"), ("EUC-H", "euc_jp")])
def test_predefined_encodings(encoding, codec):
    text = {"cp949": "한국 abc", "gbk": "汉字 abc", "big5": "漢字 abc"}.get(codec, "日本 abc")
    font = f"<< /Type /Font /Subtype /Type0 /Encoding /{encoding} /DescendantFonts [<< /DW 1000 >>] >>"
    content = f"BT /F1 1 Tf 1 0 0 1 0 9 Tm <{text.encode(codec).hex()}> Tj ET"
    assert pdf.page_layout(pdf.Document(build([content], fonts=font)), 1).runs[0][0] == text


def test_forms_with_one_name_for_two_images():
    gray = ("/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x10")
    black = ("/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x90")
    form = lambda n: (f"/Subtype /Form /Resources << /XObject << /Im0 {n} 0 R >> >>", b"/Im0 Do")
    raw = build(["/Fa Do /Fb Do /Fa Do"], {"Xa": gray, "Xb": black, "Fa": form(4), "Fb": form(5)})
    raw = raw.replace(b"/Subtype /Image /Subtype /Form", b"/Subtype /Form /Was   /Image ")
    layout = pdf.page_layout(pdf.Document(raw), 1, with_images=True)
    assert [name for _, name, _ in layout.paints] == ["Im0", "Im0#2", "Im0"]
    assert {n: o["data"] for n, o in layout.images.items()} == {"Im0": b"\x10", "Im0#2": b"\x90"}


@pytest.mark.parametrize("space", ["[/Separation /Black /DeviceCMYK 9 0 R]", "[/DeviceN [/Cyan] /DeviceCMYK 9 0 R]", "[/Lab << /WhitePoint [1 1 1] >>]", "[/Indexed [/Separation /Black /DeviceCMYK 9 0 R] 1 <0001>]"])
def test_colours_that_are_not_converted_are_absent(space):
    found = objects({"A": (f"/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace {space}", b"\x00\x01\x00\x01\x00\x01")})
    assert found["A"] == {"width": 2, "height": 1, "kind": None, "data": None}


def test_code_spaces_of_composite_fonts():
    def shown(spaces, raw):
        font = pdf.Font.__new__(pdf.Font)
        font.map, font.widths, font.default, font.spaces, font.shown, font.codec, font.wide = {}, {}, 1.0, [], {}, None, True
        font._read_map(f"{spaces} 3 beginbfchar <41> <0061> <42> <0062> <8140> <0063> endbfchar".encode())
        return font.show(bytes.fromhex(raw))

    assert shown("1 begincodespacerange <00> <FF> endcodespacerange", "414241")[:3] == ("aba", 3.0, 3)
    assert shown("2 begincodespacerange <00> <80> <8140> <9FFC> endcodespacerange", "4181404242")[:3] == ("acbb", 4.0, 4)
    assert shown("", "00418140")[:3] == ("ac", 2.0, 2)


def _by_bytes(data, step, width):
    """Row rules undone a byte at a time, after the PNG specification."""
    out, above = b"", bytes(width)
    for at in range(0, len(data), width + 1):
        rule, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            guess = {0: 0, 1: a, 2: b, 3: (a + b) // 2, 4: min((a, b, c), key=lambda x: abs(p - x))}[rule]
            row[i] = (row[i] + guess) & 255
        above = bytes(row)
        out += above
    return out


@pytest.mark.parametrize(("colours", "depth", "columns"), [(1, 8, 9), (3, 8, 7), (4, 8, 1), (3, 16, 5), (1, 1, 21), (1, 4, 3), (3, 4, 3)])
@pytest.mark.parametrize("rules", [[0], [1], [2], [1, 1, 2, 2, 0], [3], [4], [0, 4, 2, 3, 1, 4]])
def test_predictors_agree_with_a_byte_at_a_time(colours, depth, columns, rules):
    rng = np.random.default_rng(columns)
    step, width = max(1, colours * depth // 8), (colours * depth * columns + 7) // 8
    rows = [bytes([rules[i % len(rules)]]) + rng.integers(0, 256, width, dtype=np.uint8).tobytes() for i in range(13)]
    for data in (b"".join(rows), b"".join(rows)[:-3], b""):
        assert pdf._predict(data, {"Predictor": 15, "Colors": colours, "BitsPerComponent": depth, "Columns": columns}) == _by_bytes(data, step, width)


def test_an_image_has_a_deadline_and_its_loss_is_told(spark, monkeypatch):
    import time

    from quire.sources import loader

    gray = ("/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x10")
    fax = ("/Width 9 /Height 9 /BitsPerComponent 1 /Filter /CCITTFaxDecode", b"\x10")
    raw = build(["/Quick Do /Slow Do /Fax Do /Quick Do"], {"Quick": gray, "Slow": gray, "Fax": fax})
    plain, calls = pdf.image_object, []

    def slow(doc, stream):
        calls.append(1)
        if len(calls) == 2:
            until = time.monotonic() + 5
            while time.monotonic() < until:
                pass
        return plain(doc, stream)

    monkeypatch.setattr(pdf, "image_object", slow)
    began = time.monotonic()
    found = pdf.page_layout(pdf.Document(raw), 1, with_images=True, object_seconds=0.2)
    assert time.monotonic() - began < 3
    assert {n: o["data"] for n, o in found.images.items()} == {"Quick": b"\x10", "Slow": None, "Fax": None}
    assert found.lost == {"Slow": "not decoded within 0.2 s", "Fax": "no decoder for its format or colours"}
    assert set(pdf.page_layout(pdf.Document(raw), 1, with_images=True, image_seconds=0).lost) == {"Quick", "Slow", "Fax"}
    monkeypatch.undo()
    files = spark.createDataFrame([(1, bytearray(raw), None)], "doc_id long, content binary, target array<long>")
    decoded = loader.decode(files, with_images=True, object_seconds=30.0)
    assert [(r.page, r.name, r.message) for r in loader.lost_images(decoded).collect()] == [(1, "Fax", "Image Fax was not decoded: no decoder for its format or colours")]
    assert loader.image_objects(decoded).columns == ["scope", "doc_id", "page", "name", "width", "height", "kind", "data"]
