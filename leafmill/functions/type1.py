"""Type 1 font programs: reading them, their outlines, and the same font as a compact one (CFF).

A charstring is run into a list of outline steps, relative to the last point;
steps are written as Type 2 charstrings without hints or subroutines. Names of
glyphs become the new font's own strings, so no table of standard strings is
needed. A glyph that can't be run makes the whole conversion fail.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from leafmill.functions.fonts import CHARSTRING, decipher, number, private_part, without_segments
from leafmill.functions.glyphs import glyph_order
from leafmill.functions.text import safe_name_of
from leafmill.sources.objects import FormatError

# Operators of the private dictionary by key; how many standard strings come before a font's own.
PRIVATE = {
    "BlueValues": b"\x06", "OtherBlues": b"\x07", "FamilyBlues": b"\x08", "FamilyOtherBlues": b"\x09", "StdHW": b"\x0a", "StdVW": b"\x0b", "BlueScale": b"\x0c\x09", "BlueShift": b"\x0c\x0a",
    "BlueFuzz": b"\x0c\x0b", "StemSnapH": b"\x0c\x0c", "StemSnapV": b"\x0c\x0d", "ForceBold": b"\x0c\x0e", "LanguageGroup": b"\x0c\x11", "ExpansionFactor": b"\x0c\x12",
}
LISTS = ("BlueValues", "OtherBlues", "FamilyBlues", "FamilyOtherBlues", "StemSnapH", "StemSnapV")
STANDARD_STRINGS = 391
DEFAULT_MATRIX = (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)
CALLS = 10


@dataclass
class Font:
    name: str = ""
    matrix: tuple = DEFAULT_MATRIX
    box: tuple = ()
    encoding: dict[int, str] | None = None
    private: dict[str, list[float]] = field(default_factory=dict)
    subrs: dict[int, bytes] = field(default_factory=dict)
    glyphs: dict[str, bytes] = field(default_factory=dict)


def _numbers(text: bytes) -> tuple[float, ...]:
    return tuple(float(x) for x in re.findall(rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text))


def _binaries(data: bytes, start: int, entry: re.Pattern):
    """(key, bytes) of entries that say their length, one after the other; other words between them are passed over."""
    at = start
    while m := entry.search(data, at):
        end = m.end() + int(m[2])
        if end > len(data):
            return
        yield m[1], data[m.end() : end]
        at = end


def parse(program: bytes) -> Font:
    program = without_segments(program)
    secret = private_part(program)
    if secret is None:
        raise FormatError("no encrypted part")
    clear, out = program[: program.find(b"eexec")], Font()
    if m := re.search(rb"/FontName\s*/([^\s/\[\]{}()]+)", clear):
        out.name = m[1].decode("latin-1")
    if (m := re.search(rb"/FontMatrix\s*[\[{]([^\]}]*)", clear)) and len(v := _numbers(m[1])) == 6:
        out.matrix = v
    if (m := re.search(rb"/FontBBox\s*[\[{]([^\]}]*)", clear)) and len(v := _numbers(m[1])) == 4:
        out.box = v
    if m := re.search(rb"/Encoding\s+(?!StandardEncoding)\d+\s+array", clear):
        end = re.compile(rb"\b(?:readonly\s+)?def\b").search(clear, m.end())
        body = clear[m.end() : end.start() if end else None]
        out.encoding = {int(c): n.decode("latin-1") for c, n in re.findall(rb"dup\s+(\d+)\s*/([^\s/\[\]{}()]+)\s+put", body) if int(c) < 256}
    for key in PRIVATE:
        if m := re.search(rb"/" + key.encode() + rb"\s*(?:[\[{]([^\]}]*)|([-+.\d]+)|(true|false))", secret):
            values = [1.0 if m[3] == b"true" else 0.0] if m[3] else list(_numbers(m[1] if m[1] is not None else m[2]))
            if values:
                out.private[key] = values
    skip = int(m[1]) if (m := re.search(rb"/lenIV\s+(-?\d+)", secret)) else 4
    plain = lambda code: code if skip < 0 else decipher(code, CHARSTRING, skip)
    split = re.search(rb"/CharStrings\b", secret)
    if not split:
        raise FormatError("no glyphs")
    if (m := re.search(rb"/Subrs\b", secret)) and m.start() < split.start():
        for k, code in _binaries(secret, m.end(), re.compile(rb"dup\s+(\d+)\s+(\d+)\s+\S+ ")):
            out.subrs[int(k)] = plain(code)
        # subroutines may hold the word by chance: look for the glyphs behind them
        split = re.compile(rb"/CharStrings\b").search(secret, m.end() + sum(map(len, out.subrs.values()))) or split
    for name, code in _binaries(secret, split.end(), re.compile(rb"/([^\s/\[\]{}()]+)\s+(\d+)\s+\S+ ")):
        out.glyphs.setdefault(name.decode("latin-1"), plain(code))
    if not out.glyphs:
        raise FormatError("no glyphs")
    return out


class Outline:
    """The steps of a glyph: (kind, numbers), each relative to the point before."""

    def __init__(self, code: bytes, subrs: dict[int, bytes]):
        self.subrs, self.steps = subrs, []
        self.stack: list[float] = []
        self.given: list[float] = []
        self.flex: list[tuple[float, float]] | None = None
        self.width = self.bearing = 0.0
        if not self._run(code, 0):
            raise FormatError("a glyph without end")

    def _top(self, n: int) -> list[float]:
        if len(self.stack) < n:
            raise FormatError("too few numbers")
        out = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return out

    def _run(self, code: bytes, depth: int) -> bool:
        """Whether the glyph ended."""
        if depth > CALLS:
            raise FormatError("calls too deep")
        at = 0
        while at < len(code):
            b = code[at]
            at += 1
            if b >= 32:
                size = 0 if b < 247 else 1 if b < 255 else 4
                if at + size > len(code):
                    raise FormatError("a number that ends early")
                if b < 247:
                    self.stack.append(b - 139.0)
                elif b < 251:
                    self.stack.append((b - 247) * 256.0 + code[at] + 108)
                elif b < 255:
                    self.stack.append(-(b - 251) * 256.0 - code[at] - 108)
                else:
                    self.stack.append(float(struct.unpack_from(">i", code, at)[0]))
                at += size
                continue
            if b == 12:
                if at >= len(code):
                    raise FormatError("an operator that ends early")
                b = 1200 + code[at]
                at += 1
            if b == 11:
                return False
            if b == 10:
                (n,) = self._top(1)
                if int(n) not in self.subrs:
                    raise FormatError("an unknown subroutine")
                if self._run(self.subrs[int(n)], depth + 1):
                    return True
                continue
            if self._step(b):
                return True
        return False

    def _step(self, op: int) -> bool:
        moves = {4: (1, lambda y: (0.0, y)), 21: (2, lambda x, y: (x, y)), 22: (1, lambda x: (x, 0.0))}
        lines = {5: (2, lambda x, y: (x, y)), 6: (1, lambda x: (x, 0.0)), 7: (1, lambda y: (0.0, y))}
        curves = {8: (6, lambda *v: v), 30: (4, lambda a, b, c, d: (0.0, a, b, c, d, 0.0)), 31: (4, lambda a, b, c, d: (a, 0.0, b, c, 0.0, d))}
        if op in moves:
            n, shape = moves[op]
            step = shape(*self._top(n))
            if self.flex is not None:
                self.flex.append(step)
            else:
                self.steps.append(("move", step))
        elif op in lines:
            n, shape = lines[op]
            self.steps.append(("line", shape(*self._top(n))))
        elif op in curves:
            n, shape = curves[op]
            self.steps.append(("curve", tuple(shape(*self._top(n)))))
        elif op == 13:
            self.bearing, self.width = self._top(2)
            self.steps.append(("move", (self.bearing, 0.0)))
        elif op == 1207:
            self.bearing, y, self.width, _ = self._top(4)
            self.steps.append(("move", (self.bearing, y)))
        elif op == 1206:
            asb, x, y, base, accent = self._top(5)
            self.steps.append(("parts", (x - asb + self.bearing, y, base, accent)))
            return True
        elif op == 14:
            return True
        elif op == 1212:
            a, b = self._top(2)
            if not b:
                raise FormatError("a division by zero")
            self.stack.append(a / b)
            return False
        elif op == 1216:
            n, which = self._top(2)
            self._other(int(which), self._top(int(n)))
            return False
        elif op == 1217:
            if not self.given:
                raise FormatError("nothing to take")
            self.stack.append(self.given.pop())
            return False
        elif op not in (0, 1, 2, 3, 9, *range(15, 21), *range(23, 30), 1200, 1201, 1202, 1233):
            raise FormatError(f"operator {op}")
        self.stack.clear()
        return False

    def _other(self, which: int, args: list[float]) -> None:
        if which == 1:
            self.flex = []
        elif which == 0:
            points, self.flex = self.flex, None
            if points is None or len(points) != 7 or len(args) != 3:
                raise FormatError("a bent line that isn't one")
            (rx, ry), (x, y), *rest = points
            self.steps.append(("bend", (rx + x, ry + y, *(v for p in rest for v in p), args[0])))
            self.given = [args[2], args[1]]
        elif which != 2:
            self.given = args


def operand(v: float) -> bytes:
    """A number of a Type 2 charstring: a short whole one, or 16 bits before and after the point."""
    if v == int(v) and -32768 <= v <= 32767:
        return number(v) if abs(v) <= 1131 else b"\x1c" + struct.pack(">h", int(v))
    if not -32768 <= v < 32768:
        raise FormatError("a number out of range")
    return b"\xff" + struct.pack(">i", round(v * 65536))


def charstring(outline: Outline) -> bytes:
    """The width, then the steps, then the end."""
    out, first = b"", operand(outline.width)
    for kind, v in outline.steps:
        if kind == "move":
            short = {(True, False): (v[:1], b"\x16"), (False, True): (v[1:], b"\x04")}.get((v[1] == 0, v[0] == 0), (v, b"\x15")) if v != (0.0, 0.0) else (v[:1], b"\x16")
            numbers, op = short
        elif kind == "line":
            numbers, op = (v[:1], b"\x06") if v[1] == 0 else (v[1:], b"\x07") if v[0] == 0 else (v, b"\x05")
        else:
            numbers, op = v, {"curve": b"\x08", "bend": b"\x0c\x23", "parts": b"\x0e"}[kind]
        out += first + b"".join(map(operand, numbers)) + op
        first = b""
    return out if out.endswith(b"\x0e") and outline.steps and outline.steps[-1][0] == "parts" else out + first + b"\x0e"


def index(items: list[bytes]) -> bytes:
    """Items with a list of where each begins, counted from one."""
    if not items:
        return b"\0\0"
    ends = [1]
    for x in items:
        ends.append(ends[-1] + len(x))
    size = (ends[-1].bit_length() + 7) // 8
    return struct.pack(">HB", len(items), size) + b"".join(e.to_bytes(size, "big") for e in ends) + b"".join(items)


def _entry(values, op: bytes) -> bytes:
    return b"".join(map(number, values)) + op


def to_compact(program: bytes) -> bytes:
    """The font as CFF; FormatError if any glyph can't be converted."""
    font = parse(program)
    names = glyph_order(list(font.glyphs), font.encoding or {}) if font.encoding is not None else [".notdef", *(n for n in font.glyphs if n != ".notdef")]
    glyphs = [charstring(Outline(font.glyphs[n], font.subrs)) if n in font.glyphs else b"\x0e" for n in names]
    own = {n: STANDARD_STRINGS + i for i, n in enumerate(names[1:])}
    charset = b"\0" + b"".join(struct.pack(">H", own[n]) for n in names[1:])
    coded = b""
    if font.encoding is not None:
        by_glyph: dict[str, list[int]] = {}
        for code in sorted(font.encoding):
            by_glyph.setdefault(font.encoding[code], []).append(code)
        first = [by_glyph[n][0] for n in names[1:] if n in by_glyph]
        more = [(c, own[n]) for n in names[1:] for c in by_glyph.get(n, [])[1:]]
        if len(first) > 255 or len(more) > 255:
            raise FormatError("too many codes")
        coded = bytes([0x80 if more else 0, len(first), *first]) + (bytes([len(more)]) + b"".join(struct.pack(">BH", *x) for x in more) if more else b"")
    private = b""
    for key, values in font.private.items():
        if key in LISTS:
            if len(values) % 2 and not key.startswith("StemSnap"):
                continue
            values = [v - w for v, w in zip(values, [0.0, *values], strict=False)]
        private += _entry(values, PRIVATE[key])
    title, strings, charstrings = index([safe_name_of(font.name).encode()]), index([n.encode("latin-1") for n in names[1:]]), index(glyphs)

    def top(places: tuple[int, int, int, int]) -> bytes:
        fixed = lambda v: b"\x1d" + struct.pack(">i", v)
        out = (_entry(font.box, b"\x05") if font.box else b"") + (_entry(font.matrix, b"\x0c\x07") if font.matrix != DEFAULT_MATRIX else b"")
        out += fixed(places[0]) + b"\x0f" + (fixed(places[1]) + b"\x10" if coded else b"")
        return out + fixed(places[2]) + b"\x11" + fixed(len(private)) + fixed(places[3]) + b"\x12"

    start = 4 + len(title) + len(index([top((0, 0, 0, 0))])) + len(strings) + 2
    places = (start, start + len(charset), start + len(charset) + len(coded), start + len(charset) + len(coded) + len(charstrings))
    # a byte after the end keeps every place inside the data
    return b"\x01\x00\x04\x04" + title + index([top(places)]) + strings + b"\0\0" + charset + coded + charstrings + private + b"\0"
