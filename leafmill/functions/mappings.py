"""Function objects of a document, run on arrays, and color spaces that they map to device colors.

A function takes rows of inputs and gives rows of outputs: sampled ones with
any number of inputs, exponential, stitched, programs (by Machine), and lists
of functions of one output each. mapped() gives each distinct row of samples
its device color once, and joins the colors back.
"""

from __future__ import annotations

import numpy as np

from leafmill.functions.calculator import Machine, ProgramError
from leafmill.functions.color import BRADFORD, BRADFORD_BACK, D65, XYZ_TO_SRGB
from leafmill.sources.objects import Document, FormatError, Name, Stream, content_of

#: Functions inside functions, spaces on spaces, inputs of a sampled function.
DEPTH, SPACES, INPUTS = 8, 4, 16


def _limits(values, n: int) -> np.ndarray:
    pairs = np.array(values[: 2 * n], float).reshape(n, 2)
    return np.sort(pairs, axis=1)


def _clip(x: np.ndarray, limits) -> np.ndarray:
    if limits is None or len(limits) < 2 * x.shape[1]:
        return x
    pairs = _limits(limits, x.shape[1])
    return np.clip(x, pairs[:, 0], pairs[:, 1])


def _line(x, x0, x1, y0, y1):
    return np.full_like(x, y0) if x1 == x0 else y0 + (x - x0) * ((y1 - y0) / (x1 - x0))


class Function:
    def __init__(self, doc: Document, x, depth: int = 0):
        if depth > DEPTH:
            raise FormatError("functions nested too deep")
        x = doc.resolve(x)
        self.parts, self.kind = [], "list"
        if isinstance(x, list):
            self.parts = [Function(doc, f, depth + 1) for f in x]
            return
        d = x.dict if isinstance(x, Stream) else x
        if not isinstance(d, dict):
            raise FormatError("no function")
        numbers = lambda key, default=None: [float(doc.resolve(v)) for v in got] if isinstance(got := doc.get(d, key), list) else default
        self.kind, self.domain, self.range = doc.get(d, b"FunctionType"), numbers(b"Domain"), numbers(b"Range")
        if not self.domain:
            raise FormatError("a function without domain")
        if self.kind == 2:
            self.c0, self.c1, self.n = numbers(b"C0", [0.0]), numbers(b"C1", [1.0]), float(doc.get(d, b"N"))
        elif self.kind == 3:
            self.parts = [Function(doc, f, depth + 1) for f in doc.get(d, b"Functions")]
            self.bounds, self.encode = numbers(b"Bounds", []), numbers(b"Encode")
            if len(self.bounds) != len(self.parts) - 1 or len(self.encode or ()) < 2 * len(self.parts):
                raise FormatError("a stitched function without its bounds")
        elif self.kind == 4 and isinstance(x, Stream):
            self.machine = Machine(content_of(doc, x).decode("latin-1"))
        elif self.kind == 0 and isinstance(x, Stream):
            self._sampled(doc, x, numbers)
        else:
            raise FormatError(f"function type {self.kind}")

    def _sampled(self, doc: Document, x: Stream, numbers) -> None:
        size, bits = [int(v) for v in numbers(b"Size")], doc.get(x, b"BitsPerSample")
        m, n = len(self.domain) // 2, len(self.range or ()) // 2
        if len(size) != m or m > INPUTS or not n or bits not in (1, 2, 4, 8, 12, 16, 24, 32):
            raise FormatError("a sampled function that isn't whole")
        count = int(np.prod(size)) * n
        raw = np.unpackbits(np.frombuffer(content_of(doc, x), np.uint8))[: count * bits]
        if len(raw) < count * bits:
            raise FormatError("too few samples")
        values = raw.reshape(count, bits) @ (2.0 ** np.arange(bits - 1, -1, -1))
        self.table = values.reshape(*size[::-1], n)  # the first input changes fastest
        self.size, self.top = size, 2.0**bits - 1
        self.encode = numbers(b"Encode") or [v for s in size for v in (0.0, s - 1.0)]
        self.decode = numbers(b"Decode") or self.range

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of outputs; FormatError where a program fails."""
        if self.kind == "list":
            return np.concatenate([f(x)[:, :1] for f in self.parts], axis=1)
        n = len(self.domain) // 2
        if x.shape[1] < n:
            raise FormatError("too few inputs")
        x = _clip(x[:, :n].astype(float), self.domain)
        if self.kind == 2:
            t = x[:, :1] if self.n == 1 else np.abs(x[:, :1]) ** self.n * np.sign(x[:, :1])
            return np.array(self.c0) + t * (np.array(self.c1) - np.array(self.c0))
        if self.kind == 3:
            edges = [self.domain[0], *self.bounds, self.domain[1]]
            part = np.searchsorted(np.array(self.bounds), x[:, 0], side="right")
            out = None
            for k, f in enumerate(self.parts):
                rows = part == k
                if rows.any():
                    y = f(_line(x[rows, :1], edges[k], edges[k + 1], *self.encode[2 * k : 2 * k + 2]))
                    out = np.zeros((len(x), y.shape[1])) if out is None else out
                    out[rows] = y
            return np.zeros((0, 1)) if out is None else out
        if self.kind == 4:
            outputs = len(self.range or ()) // 2
            try:
                each = [self.machine.run(list(row)) for row in x]
            except (ProgramError, IndexError, ValueError, OverflowError, TypeError) as e:
                raise FormatError(str(e)) from None
            if any(len(e) < outputs for e in each):
                raise FormatError("too few outputs")
            return _clip(np.array([e[len(e) - outputs :] for e in each], float).reshape(len(x), outputs), self.range)
        return self._interpolated(x)

    def _interpolated(self, x: np.ndarray) -> np.ndarray:
        m = len(self.size)
        at = np.stack([np.clip(_line(x[:, i], *self.domain[2 * i : 2 * i + 2], *self.encode[2 * i : 2 * i + 2]), 0, self.size[i] - 1) for i in range(m)], axis=1)
        low = np.minimum(np.floor(at).astype(int), np.maximum(np.array(self.size) - 2, 0))
        share, out = at - low, np.zeros((len(x), self.table.shape[-1]))
        for corner in range(1 << m):
            up = np.array([corner >> i & 1 for i in range(m)])
            where = np.minimum(low + up, np.array(self.size) - 1)
            weight = np.prod(np.where(up, share, 1 - share), axis=1)
            out += weight[:, None] * self.table[tuple(where[:, i] for i in range(m - 1, -1, -1))]
        pairs = np.array(self.decode, float).reshape(-1, 2)
        return _clip(pairs[:, 0] + out * (pairs[:, 1] - pairs[:, 0]) / self.top, self.range)


def lab_to_rgb(lab: np.ndarray, white, limits) -> np.ndarray:
    """Rows of sRGB from 0 to 1."""
    l, a, b = np.clip(lab[:, 0], 0, 100), np.clip(lab[:, 1], *limits[:2]), np.clip(lab[:, 2], *limits[2:])  # noqa: E741
    mid = (l + 16) / 116
    cube = lambda t: np.where(t >= 6 / 29, t**3, (t - 4 / 29) * (108 / 841))
    xyz = np.stack([cube(mid + a / 500) * white[0], cube(mid) * white[1], cube(mid - b / 200) * white[2]], axis=1)
    to = np.array(BRADFORD)
    there, here = to @ np.array(D65), to @ np.array(white)
    cones = xyz @ to.T * np.divide(there, here, out=np.zeros(3), where=here != 0)
    linear = np.clip(cones @ np.array(BRADFORD_BACK).T @ np.array(XYZ_TO_SRGB).T, 0, 1)
    return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)


DEVICE = {b"DeviceGray": ("gray", 1), b"DeviceRGB": ("rgb", 3), b"DeviceCMYK": ("cmyk", 4), b"CalGray": ("gray", 1), b"CalRGB": ("rgb", 3)}


class Space:
    """A color space that isn't a device's own: channels, and their values to a device's (kind, rows from 0 to 1)."""

    def __init__(self, doc: Document, cs, depth: int = 0):
        cs = doc.resolve(cs)
        self.tint = self.white = None
        head = doc.resolve(cs[0]) if isinstance(cs, list) and cs else cs
        if depth > SPACES or not isinstance(head, Name):
            raise FormatError("color space")
        if head in DEVICE:
            self.kind, self.channels = DEVICE[bytes(head)]
            self.limits = [(0.0, 1.0)] * self.channels
        elif head == b"ICCBased":
            n = doc.get(doc.resolve(cs[1]), b"N")
            self.kind, self.channels = {1: ("gray", 1), 3: ("rgb", 3), 4: ("cmyk", 4)}[n]
            self.limits = [(0.0, 1.0)] * self.channels
        elif head == b"Lab":
            d = doc.resolve(cs[1])
            self.white = [float(v) for v in doc.get(d, b"WhitePoint")]
            ranges = [float(v) for v in doc.get(d, b"Range") or (-100, 100, -100, 100)]
            self.kind, self.channels, self.limits = "rgb", 3, [(0.0, 100.0), tuple(ranges[:2]), tuple(ranges[2:])]
        elif head in (b"Separation", b"DeviceN") and len(cs) >= 4:
            names = doc.resolve(cs[1])
            self.channels = len(names) if head == b"DeviceN" else 1
            self.limits = [(0.0, 1.0)] * self.channels
            self.base, self.tint = Space(doc, cs[2], depth + 1), Function(doc, cs[3])
            self.kind = self.base.kind
        else:
            raise FormatError("color space")

    def device(self, values: np.ndarray) -> np.ndarray:
        if self.tint is not None:
            return self.base.device(self.tint(values))
        if self.white is not None:
            return lab_to_rgb(values, self.white, [v for pair in self.limits[1:] for v in pair])
        return np.clip(values, 0, 1)


def mapped(space: Space, samples: np.ndarray, bits: int) -> np.ndarray:
    """Device bytes of rows, columns and channels of samples; each distinct sample is computed once."""
    h, w, c = samples.shape
    distinct, place = np.unique(samples.reshape(-1, c), axis=0, return_inverse=True)
    low, high = np.array(space.limits).T
    values = low + distinct / (2.0**bits - 1) * (high - low)
    out = np.floor(np.clip(space.device(values), 0, 1) * 255 + 0.5).astype(np.uint8)
    return out[place.reshape(-1)].reshape(h, w, -1)
