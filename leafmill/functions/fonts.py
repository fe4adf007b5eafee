"""Font helpers: ciphers, table directories, checksums, code maps, name tags."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.objects import FormatError, Keyword, Name, Parser, Text

# Keys of the two ciphers, their constants, first words of font files.
EEXEC, CHARSTRING, C1, C2 = 55665, 4330, 52845, 22719
MAGIC = (b"\x00\x01\x00\x00", b"OTTO", b"true", b"typ1")


def decipher(data: bytes, key: int = EEXEC, skip: int = 4) -> bytes:
    """Undoes the running-key cipher; the first bytes are chaff."""
    out = bytearray()
    for b in data:
        out.append(b ^ key >> 8)
        key = ((b + key) * C1 + C2) & 0xFFFF
    return bytes(out[skip:])


def encipher(data: bytes, key: int = EEXEC, lead: bytes = b"\0\0\0\0") -> bytes:
    out = bytearray()
    for b in lead + data:
        c = b ^ key >> 8
        out.append(c)
        key = ((c + key) * C1 + C2) & 0xFFFF
    return bytes(out)


def without_segments(data: bytes) -> bytes:
    """A font program without the headers of its binary wrapper."""
    out, at = b"", 0
    while data[at : at + 1] == b"\x80" and len(data) >= at + 6 and data[at + 1] in (1, 2):
        size = int.from_bytes(data[at + 2 : at + 6], "little")
        out += data[at + 6 : at + 6 + size]
        at += 6 + size
    return out if at else data


def private_part(program: bytes) -> bytes | None:
    """What follows eexec, deciphered, whether it is in hex or in bytes."""
    at = program.find(b"eexec")
    if at < 0:
        return None
    body = program[at + 5 :].lstrip(b" \t\r\n")
    if re.fullmatch(rb"[0-9A-Fa-f\s]{4,}", body[:8]):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
        body = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    return decipher(body)


def checksum(table: bytes) -> int:
    """Sum of big-endian words, modulo 2^32, the last filled with zeros."""
    words = np.frombuffer(table + b"\0" * (-len(table) % 4), ">u4")
    return int(words.sum(dtype=np.uint64)) & 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def checksums(tables: pd.Series) -> pd.Series:
    return tables.map(lambda t: checksum(bytes(t)), na_action="ignore").astype("Int64")


def tables_of(font: bytes) -> dict[bytes, bytes]:
    """Tables by tag; records that point outside the font are left out."""
    if font[:4] not in MAGIC:
        raise FormatError("no font")
    out = {}
    for k in range(struct.unpack_from(">H", font, 4)[0]):
        tag, _, at, size = struct.unpack_from(">4sIII", font, 12 + 16 * k)
        if at + size <= len(font):
            out[tag] = font[at : at + size]
    return out


def build_font(tables: dict[bytes, bytes], magic: bytes = MAGIC[0]) -> bytes:
    """A font file: directory sorted by tag, tables filled up to four bytes."""
    n = len(tables)
    power = max(1, 1 << (n.bit_length() - 1))
    head = magic + struct.pack(">HHHH", n, power * 16, power.bit_length() - 1, (n - power) * 16)
    at, records, body = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        data = tables[tag]
        records += struct.pack(">4sIII", tag, checksum(data), at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + records + body


def subset_tag(glyphs: list[int]) -> str:
    """Six letters from the glyph set: FNV-1a over its numbers in order, written in base 26."""
    h = 0xCBF29CE484222325
    for g in sorted(set(glyphs)):
        for b in struct.pack(">I", g):
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    out = ""
    for _ in range(6):
        h, k = divmod(h, 26)
        out += chr(65 + k)
    return out


def differences(items: list) -> dict[int, bytes]:
    """Codes by the numbers and names of a Differences array."""
    out, code = {}, 0
    for x in items:
        if isinstance(x, Name):
            if 0 <= code < 256:
                out[code] = bytes(x)
            code += 1
        elif isinstance(x, int) and not isinstance(x, bool):
            code = x
        else:
            raise FormatError("neither number nor name")
    return out


def number(value: float) -> bytes:
    """A number of a compact font's dictionary: the shortest whole form, or packed decimal digits."""
    if value == int(value) and abs(value) < 2**31:
        v = int(value)
        if -107 <= v <= 107:
            return bytes([v + 139])
        if 108 <= v <= 1131:
            return struct.pack(">H", v - 108 + (247 << 8))
        if -1131 <= v <= -108:
            return struct.pack(">H", -v - 108 + (251 << 8))
        return b"\x1c" + struct.pack(">h", v) if -32768 <= v <= 32767 else b"\x1d" + struct.pack(">i", v)
    text = repr(float(value)).replace("e-", "c").replace("e+", "b").replace("e", "b").replace("-", "e").replace(".", "a") + "f"
    return b"\x1e" + bytes.fromhex(text + "f" * (len(text) % 2))


@dataclass
class CodeMap:
    """Codes of one to four bytes to character numbers."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)  # bytes, low, high
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # bytes, low, high, number
    identity: bool = False

    @classmethod
    def named(cls, name: bytes) -> CodeMap | None:
        return cls([(2, 0, 0xFFFF)], [], True) if name in (b"Identity-H", b"Identity-V") else None

    @classmethod
    def parse(cls, content: bytes) -> CodeMap:
        """The map of a stream; FormatError if it can't be read or maps nothing."""
        out, p, operands = cls(), Parser(content, keywords=True), []

        def code(x):
            if not isinstance(x, Text) or not 1 <= len(x) <= 4:
                raise FormatError("no code")
            return int.from_bytes(x, "big"), len(x)

        to = lambda x: x if isinstance(x, int) and x >= 0 else code(x)[0]
        while not p.done():
            v = p.value()
            if not isinstance(v, Keyword):
                operands.append(v)
                continue
            if v == b"endcodespacerange":
                out.spaces += [(code(a)[1], code(a)[0], code(b)[0]) for a, b in zip(operands[::2], operands[1::2], strict=False)]
            elif v in (b"endcidrange", b"endbfrange"):
                out.ranges += [(code(a)[1], code(a)[0], code(b)[0], to(c)) for a, b, c in zip(operands[::3], operands[1::3], operands[2::3], strict=False)]
            elif v in (b"endcidchar", b"endbfchar"):
                out.ranges += [(code(a)[1], code(a)[0], code(a)[0], to(b)) for a, b in zip(operands[::2], operands[1::2], strict=False)]
            elif v == b"usecmap":
                other = cls.named(bytes(operands[-1])) if operands and isinstance(operands[-1], Name) else None
                if other is None:
                    raise FormatError("an unknown map")
                out.spaces, out.identity = out.spaces + other.spaces, other.identity
            operands = []
        if not out.spaces:
            out.spaces = [(n, 0, 256**n - 1) for n in sorted({r[0] for r in out.ranges})]
        if not out.spaces:
            raise FormatError("an empty map")
        return out

    def numbers(self, text: bytes) -> list[int]:
        """Of each code the first range's number; the shortest space that holds the bytes gives the code's length."""
        out, at, shortest = [], 0, min(n for n, _, _ in self.spaces)
        while at < len(text):
            value = lambda n: int.from_bytes(text[at : at + n], "big")  # noqa: B023, E731
            fits = (n for n in range(1, min(4, len(text) - at) + 1) if any(s == n and low <= value(n) <= high for s, low, high in self.spaces))
            size = next(fits, min(shortest, len(text) - at))
            hit = next((to + value(size) - low for n, low, high, to in self.ranges if n == size and low <= value(size) <= high), None)
            out.append(hit if hit is not None else value(size) if self.identity else 0)
            at += size
        return out
