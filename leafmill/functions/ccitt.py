"""Two-dimensional fax coding (group 4) of rows of black and white."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np

# Code words of runs, in order of their lengths: 0 to 63, then 64 to 1728 by 64, then 1792 to 2560 by 64 for both colors.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
WHITE_LONG = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 "
    "011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
BLACK_LONG = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 "
    "0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
BOTH_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# Code words of the modes; a vertical one by how far right of the reference the change lies.
PASS, ACROSS = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


@lru_cache(maxsize=1)
def runs() -> tuple[dict[int, str], dict[int, str]]:
    """Code words by run length, for white and for black."""
    return tuple(dict(enumerate(short)) | {64 * (i + 1): w for i, w in enumerate([*long, *BOTH_LONG])} for short, long in ((WHITE, WHITE_LONG), (BLACK, BLACK_LONG)))


def _run(n: int, color: int) -> str:
    words, out = runs()[color], ""
    while n >= 2560:
        out, n = out + words[2560], n - 2560
    if n >= 64:
        out, n = out + words[n // 64 * 64], n % 64
    return out + words[n]


def changes(row: np.ndarray) -> list[int]:
    """Where the color changes, white before the first; the first change is to black."""
    return np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8))))).tolist()


def _next(at: list[int], a: int, color: int, width: int) -> int:
    """Index of the first change right of a that is to the other color; len(at) if there is none."""
    k = bisect_right(at, a)
    return k + (k % 2 != color)


def encode(black: np.ndarray) -> bytes:
    """Rows of truth values (black) to code words."""
    width, before, out = black.shape[1], [], []
    for row in black:
        here, a, color = changes(row), -1, 0
        get = lambda at, k: at[k] if k < len(at) else width
        while a < width:
            ka, kb = _next(here, a, color, width), _next(before, a, color, width)
            a1, b1, b2 = get(here, ka), get(before, kb), get(before, kb + 1)
            if b2 < a1:
                out.append(PASS)
                a = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a, color = a1, 1 - color
            else:
                a2 = get(here, ka + 1)
                out += [ACROSS, _run(a1 - max(a, 0), color), _run(a2 - a1, 1 - color)]
                a = a2
        before = here
    bits = "".join(out) + END
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


@lru_cache(maxsize=1)
def _words() -> tuple[dict[str, object], dict[str, int], dict[str, int]]:
    modes = {PASS: "pass", ACROSS: "across"} | {w: d for d, w in VERTICAL.items()}
    return modes, *({w: n for n, w in table.items()} for table in runs())


class _Bits:
    def __init__(self, data: bytes):
        self.bits = (np.unpackbits(np.frombuffer(data, np.uint8)) + 48).tobytes().decode()
        self.at = 0

    def word(self, words: dict, longest: int = 13):
        for n in range(1, longest + 1):
            w = self.bits[self.at : self.at + n]
            if w in words and len(w) == n:
                self.at += n
                return words[w]
        raise ValueError("no code word")

    def run(self, words: dict[str, int]) -> int:
        total = 0
        while True:
            n = self.word(words)
            total += n
            if n < 64:
                return total


def decode(data: bytes, width: int, height: int = 0, aligned: bool = False) -> np.ndarray:
    """Rows of truth values (black); without a height until the end is coded. ValueError if the data end early."""
    modes, *tables = _words()
    bits, before, rows = _Bits(data), [], []
    while not height or len(rows) < height:
        if aligned:
            bits.at = -(-bits.at // 8) * 8
        if bits.bits.startswith(END[:12], bits.at) or (not height and bits.at >= len(bits.bits) - 7):
            break
        here, a, color = [], -1, 0
        get = lambda at, k: at[k] if k < len(at) else width
        while a < width:
            mode = bits.word(modes, 7)
            kb = _next(before, a, color, width)
            if mode == "pass":
                a = get(before, kb + 1)
            elif mode == "across":
                a1 = max(a, 0) + bits.run(tables[color])
                a = a1 + bits.run(tables[1 - color])
                here += [a1, a]
            else:
                a = get(before, kb) + mode
                here.append(a)
                color = 1 - color
        before = _tidy(here, width)
        row = np.zeros(width + 1, np.int8)
        for k, x in enumerate(before):
            row[x] += 1 - 2 * (k % 2)
        rows.append(np.cumsum(row)[:width] > 0)
    if height and len(rows) < height:
        raise ValueError("too few rows")
    return np.array(rows, bool).reshape(-1, width)


def _tidy(at: list[int], width: int) -> list[int]:
    """Changes without those that cancel each other (runs of no length) or lie at the end."""
    out: list[int] = []
    for x in at:
        if out and out[-1] == x:
            out.pop()
        else:
            out.append(x)
    while out and out[-1] >= width:
        out.pop()
    return out
