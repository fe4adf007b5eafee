"""A Type 1 font built here, converted, and read back with a small reader of compact fonts."""

import struct

import pytest

from leafmill.sources import probes as make
from leafmill.functions import fonts, type1
from leafmill.functions.text import standard_font_of
from leafmill.operators import stages
from leafmill.sources.objects import FormatError, Name, Ref, Stream, content_of, read, write


def t1(*items) -> bytes:
    """A Type 1 charstring of numbers and operators (as bytes)."""
    out = b""
    for x in items:
        out += x if isinstance(x, bytes) else bytes([x + 139]) if -107 <= x <= 107 else b"\xff" + struct.pack(">i", x)
    return out


HSBW, END, RET, CALL, DIV, OTHER, POP, SEAC = b"\x0d", b"\x0e", b"\x0b", b"\x0a", b"\x0c\x0c", b"\x0c\x10", b"\x0c\x11", b"\x0c\x06"
R, H, V, RL, HL, VL, RC, VH, HV, HSTEM, CLOSE = b"\x15", b"\x16", b"\x04", b"\x05", b"\x06", b"\x07", b"\x08", b"\x1e", b"\x1f", b"\x01", b"\x09"
SUBRS = [t1(3, 0, OTHER, POP, POP, b"\x0c\x21", RET), t1(0, 1, OTHER, RET), t1(0, 2, OTHER, RET), t1(RET), t1(50, HL, RET)]
FLEX = (1, CALL, 10, 5, R, 2, CALL, *sum(([a, b, R, 2, CALL] for a, b in ((1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, -12))), []), 50, 300, 200, 0, CALL)
GLYPHS = {
    ".notdef": t1(0, 250, HSBW, END),
    "A": t1(20, 600, HSBW, 10, 20, HSTEM, 100, 700, R, 30, HL, -40, VL, 5, 6, RL, 1, 2, 3, 4, 5, 6, RC, 1, 2, 3, 4, VH, 5, 6, 7, 8, HV, CLOSE, END),
    "B": t1(0, 500, HSBW, 4, CALL, 7, 2, DIV, VL, CLOSE, END),
    "flexed": t1(0, 500, HSBW, 100, H, *FLEX, CLOSE, END),
    "Aacute": t1(20, 600, HSBW, 5, 30, 40, 65, 194, SEAC),
}


def program(glyphs=GLYPHS, hexed=False) -> bytes:
    clear = b"%!PS-AdobeFont-1.0: Made\n/FontName /Made def\n/FontMatrix [0.001 0 0 0.001 0 0] readonly def\n/FontBBox {-10 -20 1000 900} readonly def\n"
    clear += b"/Encoding 256 array\n0 1 255 {1 index exch /.notdef put} for\ndup 66 /A put\ndup 65 /B put\ndup 70 /A put\nreadonly def\ncurrentfile eexec\n"
    secret = b"dup /Private 8 dict dup begin /RD {string currentfile exch readstring pop} executeonly def /BlueValues [-15 0 500 515] def /StdHW [30] def /BlueScale 0.04 def /ForceBold false def\n"
    lock = lambda code: fonts.encipher(code, fonts.CHARSTRING)
    secret += b"/Subrs %d array\n" % len(SUBRS) + b"".join(b"dup %d %d RD " % (i, len(lock(c))) + lock(c) + b" NP\n" for i, c in enumerate(SUBRS))
    secret += b"ND\n2 index /CharStrings %d dict dup begin\n" % len(glyphs) + b"".join(b"/%s %d RD " % (n.encode(), len(lock(c))) + lock(c) + b" ND\n" for n, c in glyphs.items()) + b"end\n"
    body = fonts.encipher(secret)
    return clear + (body.hex().encode() if hexed else body) + b"\n" + b"0" * 64 + b"\ncleartomark"


class Compact:
    """Just enough of a reader to check what was written."""

    def __init__(self, data: bytes):
        at = data[2]
        (self.name,), at = self.index(data, at)
        (top,), at = self.index(data, at)
        strings, at = self.index(data, at)
        _, at = self.index(data, at)
        self.top = self.dict(top)
        charstrings, _ = self.index(data, int(self.top[17][0]))
        at = int(self.top[15][0])
        assert data[at] == 0
        sids = struct.unpack_from(f">{len(charstrings) - 1}H", data, at + 1)
        self.names = [".notdef", *(strings[s - 391].decode() for s in sids)]
        self.glyphs = dict(zip(self.names, charstrings, strict=True))
        size, at = map(int, self.top[18])
        self.private = self.dict(data[at : at + size])
        self.codes = {}
        if 16 in self.top:
            at = int(self.top[16][0])
            n = data[at + 1]
            self.codes = {c: self.names[i + 1] for i, c in enumerate(data[at + 2 : at + 2 + n])}
            if data[at] & 0x80:
                at += 2 + n
                for k in range(data[at]):
                    code, sid = struct.unpack_from(">BH", data, at + 1 + 3 * k)
                    self.codes[code] = strings[sid - 391].decode()

    @staticmethod
    def index(data, at):
        n = struct.unpack_from(">H", data, at)[0]
        if not n:
            return [], at + 2
        size = data[at + 2]
        ends = [int.from_bytes(data[at + 3 + size * k : at + 3 + size * (k + 1)], "big") for k in range(n + 1)]
        base = at + 2 + size * (n + 1)
        return [data[base + a : base + b] for a, b in zip(ends, ends[1:], strict=False)], base + ends[-1]

    @staticmethod
    def dict(data):
        out, stack, at = {}, [], 0
        while at < len(data):
            b = data[at]
            at += 1
            if b <= 21:
                key = 1200 + data[at] if b == 12 else b
                at += b == 12
                out[key], stack = stack, []
            elif b == 28:
                stack.append(struct.unpack_from(">h", data, at)[0])
                at += 2
            elif b == 29:
                stack.append(struct.unpack_from(">i", data, at)[0])
                at += 4
            elif b == 30:
                text = ""
                while "f" not in text:
                    text += data[at : at + 1].hex()
                    at += 1
                stack.append(float(text.split("f")[0].replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-")))
            elif b < 247:
                stack.append(b - 139)
            else:
                stack.append((b - 247) * 256 + data[at] + 108 if b < 251 else -(b - 251) * 256 - data[at] - 108)
                at += 1
        return out


def run2(code: bytes):
    """Width and absolute points of a Type 2 charstring."""
    stack, at, x, y, width, out = [], 0, 0.0, 0.0, None, []
    arity = {4: 1, 22: 1, 21: 2, 14: 0}
    while at < len(code):
        b = code[at]
        at += 1
        if b >= 32 or b == 28:
            if b == 28:
                stack.append(struct.unpack_from(">h", code, at)[0])
                at += 2
            elif b < 247:
                stack.append(b - 139)
            elif b == 255:
                stack.append(struct.unpack_from(">i", code, at)[0] / 65536)
                at += 4
            else:
                stack.append((b - 247) * 256 + code[at] + 108 if b < 251 else -(b - 251) * 256 - code[at] - 108)
                at += 1
            continue
        if b == 12:
            b = 1200 + code[at]
            at += 1
        if width is None and b in arity:
            extra = len(stack) - (4 if b == 14 and len(stack) >= 4 else arity[b])
            width = stack.pop(0) if extra == 1 else None
        pairs = {22: lambda s: [(s[0], 0)], 4: lambda s: [(0, s[0])], 6: lambda s: [(s[0], 0)], 7: lambda s: [(0, s[0])], 1235: lambda s: list(zip(s[:12:2], s[1:12:2], strict=True))}
        for dx, dy in pairs.get(b, lambda s: list(zip(s[::2], s[1::2], strict=True)))(stack) if b != 14 else []:
            x, y = x + dx, y + dy
            out.append((round(x, 3), round(y, 3)))
        if b == 14:
            return width, out, stack
        stack = []
    raise AssertionError("no end")


@pytest.mark.parametrize("hexed", [False, True])
def test_conversion(hexed):
    got = Compact(type1.to_compact(program(hexed=hexed)))
    assert got.name == b"Made" and set(got.names) == set(GLYPHS) and got.names[:3] == [".notdef", "B", "A"]
    assert got.codes == {65: "B", 66: "A", 70: "A"}
    assert got.top[5] == [-10, -20, 1000, 900]
    assert got.private[6] == [-15, 15, 500, 15] and got.private[10] == [30] and got.private[1209] == [0.04] and got.private[1214] == [0]
    assert run2(got.glyphs[".notdef"])[0] == 250
    width, points, _ = run2(got.glyphs["A"])
    want, (x, y) = [(20, 0), (120, 700), (150, 700), (150, 660), (155, 666)], (155, 666)
    for dx, dy in ((1, 2), (3, 4), (5, 6), (0, 1), (2, 3), (4, 0), (5, 0), (6, 7), (0, 8)):
        x, y = x + dx, y + dy
        want.append((x, y))
    assert width == 600 and points == want
    assert run2(got.glyphs["B"])[1] == [(0, 0), (50, 0), (50, 3.5)]
    width, points, left = run2(got.glyphs["flexed"])
    assert points[1:4] == [(100, 0), (111, 7), (114, 11)] and len(points) == 8
    assert run2(got.glyphs["Aacute"])[2] == [30 - 5 + 20, 40, 65, 194]


def test_what_cannot_be_converted():
    for code in (t1(0, 1, HSBW), t1(0, 1, HSBW, 99, CALL, END), t1(RL), t1(0, 1, HSBW, 1, 0, DIV, END), t1(b"\x0c\x50"), t1(0, 1, HSBW, 3, CALL, 1, 0, OTHER, END)):
        with pytest.raises(FormatError):
            type1.to_compact(program(GLYPHS | {"bad": code}))
    for bad in (b"", b"eexec", b"%!\ncurrentfile eexec\n" + fonts.encipher(b"/Private")):
        with pytest.raises(FormatError):
            type1.to_compact(bad)


def document(base_font: bytes, extra=b"") -> bytes:
    doc = make.page(b"BT /F 12 Tf (AB) Tj ET")
    body = program() + extra
    holder = doc.add({b"Type": Name(b"FontDescriptor"), b"FontName": Name(base_font), b"Flags": 32, b"FontFile": doc.add(Stream({b"Length1": 1}, body))})
    font = doc.add({b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(base_font), b"FontDescriptor": holder, b"Encoding": Name(b"WinAnsiEncoding")})
    doc.objects[Ref(3, 0)][b"Resources"] = {b"Font": {b"F": font}}
    return write(doc, False)


def test_fonts_of_a_document():
    out, report, _ = stages.compress(document(b"Made"), "standard")
    assert report.fonts[0]["action"] == "converted to CFF"
    doc = read(out)
    program_ = next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Type1C")
    assert Compact(content_of(doc, program_)).name == b"Made"
    assert stages.compress(document(b"Made"), "less")[1].fonts[0]["action"] == "kept"
    out, report, _ = stages.compress(document(b"Arial,Bold"), "more")
    assert report.fonts[0]["action"] == "unembedded" and report.fonts[0]["bytes_out"] == 0
    assert any(isinstance(x, dict) and x.get(b"BaseFont") == b"Helvetica-Bold" for x in read(out).objects.values())


def test_standard_fonts_one_by_one():
    assert [standard_font_of(n) for n in ("ABCDEF+Arial-BoldMT", "Symbol,Bold", "Times New Roman", "Verdana")] == ["Helvetica-Bold", None, "Times-Roman", None]
