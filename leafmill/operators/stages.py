"""What is done to one document: guards, usage, images, stripping, structure, verification.

Each stage changes a sources.objects.Document in place and appends to a
Report. The functions run inside Arrow batches, one document at a time; the
tables that they report are joined and summed by DataFrame operations.
"""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from leafmill.functions.ccitt import encode as encode_fax
from leafmill.functions.color import OVERPRINTS
from leafmill.functions.glyphs import character
from leafmill.functions.mappings import Space, mapped
from leafmill.functions.text import STANDARD_ENCODINGS, category_of, standard_font_of
from leafmill.functions.type1 import to_compact
from leafmill.operators.presets import PRESETS, STRIP_RULES, TINY, WRAPPER
from leafmill.sources.objects import Document, FormatError, Name, Parser, Ref, Stream, Text, canonical, content_of, operations, read, references, smaller

#: Passes of merging; forms inside forms; problems kept of a verification; bytes of a content stream that is rebuilt.
PASSES, DEPTH, PROBLEMS, REBUILT = 8, 16, 50, 64 << 20


class Refusal(Exception):
    """A document that is left alone, and why."""


@dataclass
class Report:
    images: list[dict] = field(default_factory=list)
    fonts: list[dict] = field(default_factory=list)
    stages: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


# ---- reading the graph


def pages_of(doc: Document) -> list[Ref]:
    """Pages in order, through Kids; each node once."""
    out, seen, todo = [], set(), [doc.get(doc.trailer.get(b"Root"), b"Pages") and doc.resolve(doc.trailer.get(b"Root")).get(b"Pages")]
    while todo:
        ref = todo.pop(0)
        node = doc.resolve(ref)
        if not isinstance(ref, Ref) or ref in seen or not isinstance(node, dict):
            continue
        seen.add(ref)
        kids = doc.get(node, b"Kids")
        if isinstance(kids, list):
            todo[:0] = kids
        elif node.get(b"Type") in (b"Page", None):
            out.append(ref)
    return out


def reachable(doc: Document) -> set[Ref]:
    seen, todo = set(), [r for _, r in references(doc.trailer)]
    while todo:
        ref = todo.pop()
        if ref not in seen and ref in doc.objects:
            seen.add(ref)
            todo += [r for _, r in references(doc.objects[ref])]
    return seen


def page_content(doc: Document, page: Ref) -> bytes | None:
    """The page's content streams, joined by line feeds; None if one can't be decoded."""
    parts = doc.get(page, b"Contents")
    parts = parts if isinstance(parts, list) else [parts]
    out = []
    for p in map(doc.resolve, parts):
        if p is None:
            continue
        try:
            out.append(content_of(doc, p) if isinstance(p, Stream) else b"")
        except FormatError:
            return None
    return b"\n".join(out)


# ---- guards


def guard(doc: Document) -> None:
    """Raises Refusal for what would come out damaged."""
    if b"Encrypt" in doc.trailer:
        raise Refusal("password required")
    root = doc.resolve(doc.trailer.get(b"Root"))
    tree = doc.get(root, b"Pages")
    seen, todo = set(), [tree] if isinstance(tree, dict) else []
    while todo:
        node = todo.pop()
        if id(node) in seen:
            continue
        seen.add(id(node))
        for kid in doc.get(node, b"Kids") or []:
            target = doc.resolve(kid)
            if not isinstance(kid, Ref) or not isinstance(target, dict):
                raise Refusal("broken page tree")
            todo.append(target)
    for ref in reachable(doc):
        x = doc.objects[ref]
        d = x.dict if isinstance(x, Stream) else x
        if not isinstance(d, dict):
            continue
        if isinstance(x, dict) and x.get(b"Type") == b"Page":
            parts = x.get(b"Contents")
            for part in parts if isinstance(parts, list) else [parts]:
                if isinstance(part, Ref):
                    target = doc.resolve(part)
                    if target is None or isinstance(target, Stream) and not target.data and b"Length" not in target.dict:
                        raise Refusal("missing content")
        if b"Resources" in d:
            res = doc.resolve(d[b"Resources"])
            if not isinstance(res, dict):
                raise Refusal("missing resources")
            for category in map(doc.resolve, res.values()):
                for entry in category.values() if isinstance(category, dict) else ():
                    if isinstance(entry, Ref) and doc.resolve(entry) is None:
                        raise Refusal("missing resources")


def normalize(doc: Document) -> None:
    """Strings with unprintable bytes are written in hex; parameters of no filter go."""

    def visit(x):
        if isinstance(x, Text):
            x.hexed = x.hexed or any(b < 32 or b > 126 for b in x)
        elif isinstance(x, (list, dict)):
            for y in x.values() if isinstance(x, dict) else x:
                visit(y)

    for x in [*doc.objects.values(), doc.trailer]:
        visit(x.dict if isinstance(x, Stream) else x)
        if isinstance(x, Stream) and doc.resolve(x.dict.get(b"Filter")) == []:
            for key in (b"Filter", b"DecodeParms"):
                x.dict.pop(key, None)


# ---- usage


@dataclass
class State:
    matrix: tuple = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    clip: tuple = (-1e9, -1e9, 1e9, 1e9)
    font: object = None


def compose(m, n):
    (a, b, c, d, e, f), (p, q, r, s, t, u) = m, n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def corners(box, m) -> tuple:
    xs = [m[0] * x + m[2] * y + m[4] for x in box[::2] for y in box[1::2]]
    ys = [m[1] * x + m[3] * y + m[5] for x in box[::2] for y in box[1::2]]
    return min(xs), min(ys), max(xs), max(ys)


def meet(a, b) -> tuple:
    x, y = max(a[0], b[0]), max(a[1], b[1])
    return x, y, max(x, min(a[2], b[2])), max(y, min(a[3], b[3]))


def box_of(doc: Document, x) -> tuple | None:
    v = [doc.resolve(n) for n in x] if isinstance(x := doc.resolve(x), list) else []
    if len(v) != 4 or not all(isinstance(n, (int, float)) and not isinstance(n, bool) for n in v):
        return None
    return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])


class Usage:
    """Where images are drawn, which strings fonts show, which resource names each owner uses."""

    def __init__(self, doc: Document, walk: bool = True):
        self.doc = doc
        self.placements: dict[Ref, list[tuple]] = {}
        self.strings: dict[Ref, set[bytes]] = {}
        self.busy: list[Ref] = []
        for page in pages_of(doc) if walk else ():
            chain = [r for r in [self._inherited(page, b"Resources")] if isinstance(r, dict)]
            boxes = [b for b in (box_of(doc, doc.get(page, k)) for k in (b"MediaBox", b"CropBox")) if b]
            state = State(clip=boxes[0] if len(boxes) == 1 else meet(*boxes) if boxes else State.clip)
            content = page_content(doc, page)
            if content is not None:
                self.walk(content, chain, state)
            for note in doc.get(page, b"Annots") or []:
                self._annotation(doc.resolve(note), chain)

    def _inherited(self, ref, key):
        seen = set()
        while isinstance(node := self.doc.resolve(ref), dict) and ref not in seen:
            if key in node:
                return self.doc.resolve(node[key])
            seen.add(ref)
            ref = node.get(b"Parent")

    def _find(self, chain, category: bytes, name, want: type):
        for res in chain:
            entry = (self.doc.resolve(res.get(category)) or {}).get(bytes(name))
            if isinstance(entry, Ref) and (want is Ref or isinstance(self.doc.resolve(entry), want)):
                return entry
        return None

    def _annotation(self, note, chain) -> None:
        rect = box_of(self.doc, self.doc.get(note, b"Rect"))
        form = self.doc.resolve(note.get(b"AP")).get(b"N") if isinstance(note, dict) and isinstance(self.doc.resolve(note.get(b"AP")), dict) else None
        if isinstance(self.doc.resolve(form), dict) and isinstance(as_ := self.doc.get(note, b"AS"), Name):
            form = self.doc.resolve(form).get(bytes(as_))
        stream = self.doc.resolve(form)
        if not isinstance(form, Ref) or not isinstance(stream, Stream) or not rect:
            return
        seen = corners(box_of(self.doc, stream.dict.get(b"BBox")) or rect, self._matrix(stream))
        sx = (rect[2] - rect[0]) / (seen[2] - seen[0]) if seen[2] > seen[0] else 1.0
        sy = (rect[3] - rect[1]) / (seen[3] - seen[1]) if seen[3] > seen[1] else 1.0
        self._form(form, stream, chain, State((sx, 0.0, 0.0, sy, rect[0] - seen[0] * sx, rect[1] - seen[1] * sy), rect))

    def _matrix(self, stream: Stream) -> tuple:
        m = [self.doc.resolve(v) for v in self.doc.resolve(stream.dict.get(b"Matrix")) or []]
        return tuple(map(float, m)) if len(m) == 6 and all(isinstance(v, (int, float)) for v in m) else State.matrix

    def _form(self, ref: Ref, stream: Stream, chain, state: State) -> None:
        if ref in self.busy or len(self.busy) >= DEPTH:
            return
        try:
            content = content_of(self.doc, stream)
        except FormatError:
            return
        matrix = compose(self._matrix(stream), state.matrix)
        box = box_of(self.doc, stream.dict.get(b"BBox"))
        own = self.doc.resolve(stream.dict.get(b"Resources"))
        self.busy.append(ref)
        self.walk(content, [own, *chain] if isinstance(own, dict) else chain, State(matrix, meet(state.clip, corners(box, matrix)) if box else state.clip, state.font))
        self.busy.pop()

    def walk(self, content: bytes, chain, state: State) -> None:
        try:
            ops = operations(content)
        except FormatError:
            return
        first, stack, path, pending = state, [], [], False
        for op, args in ops:
            nums = [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if op == b"q":
                stack.append(state)
            elif op == b"Q":
                state = stack.pop() if stack else first
            elif op == b"cm" and len(nums) == 6:
                state = State(compose(nums, state.matrix), state.clip, state.font)
            elif op == b"Tf" and args:
                state = State(state.matrix, state.clip, self._find(chain, b"Font", args[0], Ref) if isinstance(args[0], Name) else None)
            elif op in (b"Tj", b"'", b'"', b"TJ") and args and state.font:
                last = args[-1] if isinstance(args[-1], list) else [args[-1]]
                self.strings.setdefault(state.font, set()).update(bytes(s) for s in last if isinstance(s, Text))
            elif op == b"re" and len(nums) == 4:
                path += [(nums[0], nums[1]), (nums[0] + nums[2], nums[1] + nums[3]), (nums[0] + nums[2], nums[1]), (nums[0], nums[1] + nums[3])]
            elif op in (b"m", b"l", b"c", b"v", b"y"):
                path += list(zip(nums[::2], nums[1::2], strict=False))
            elif op in (b"W", b"W*"):
                pending = True
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if pending:
                    m, pts = state.matrix, path
                    xs, ys = [m[0] * x + m[2] * y + m[4] for x, y in pts], [m[1] * x + m[3] * y + m[5] for x, y in pts]
                    box = (min(xs), min(ys), max(xs), max(ys)) if pts else (0.0, 0.0, 0.0, 0.0)
                    state = State(state.matrix, meet(state.clip, box), state.font)
                path, pending = [], False
            elif op == b"Do" and args and isinstance(args[0], Name):
                ref = self._find(chain, b"XObject", args[0], Stream)
                stream = self.doc.resolve(ref)
                kind = self.doc.get(stream, b"Subtype") if ref else None
                if kind == b"Image":
                    self._place(ref, state)
                elif kind == b"Form":
                    self._form(ref, stream, chain, state)
            elif op in (b"scn", b"SCN") and args and isinstance(args[-1], Name):
                ref = self._find(chain, b"Pattern", args[-1], Stream)
                if ref and self.doc.get(ref, b"PatternType") == 1:
                    self._form(ref, self.doc.resolve(ref), chain, State(State.matrix, state.clip))

    def _place(self, ref: Ref, state: State) -> None:
        m = state.matrix
        width, height = float(np.hypot(m[0], m[1])), float(np.hypot(m[2], m[3]))
        whole = corners((0, 0, 1, 1), m)
        seen, det = meet(whole, state.clip), m[0] * m[3] - m[1] * m[2]
        part = None
        if abs(det) >= 1e-12 and not all(a <= b + 1e-4 for a, b in zip((*state.clip[:2], *whole[2:]), (*whole[:2], *state.clip[2:]), strict=True)):
            if seen[2] <= seen[0] or seen[3] <= seen[1]:
                part = (0.0, 0.0, 0.0, 0.0)
            else:
                back = (m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)
                part = meet((0, 0, 1, 1), corners(seen, back))
        self.placements.setdefault(ref, []).append((width, height, part))

    def resolution(self, ref: Ref, w: int, h: int) -> float | None:
        each = [min(w / (a / 72) if a else float("inf"), h / (b / 72) if b else float("inf")) for a, b, _ in self.placements.get(ref, ())]
        return min(each, default=None)

    def crop(self, ref: Ref) -> tuple | None:
        parts = [p for *_, p in self.placements.get(ref, ())]
        if not parts or None in parts:
            return None
        return tuple(f(v) for f, v in zip((min, min, max, max), zip(*parts, strict=True), strict=True))


# ---- images

SPACES = {b"DeviceGray": ("gray", 1), b"G": ("gray", 1), b"CalGray": ("gray", 1), b"DeviceRGB": ("rgb", 3), b"RGB": ("rgb", 3), b"CalRGB": ("rgb", 3), b"DeviceCMYK": ("cmyk", 4), b"CMYK": ("cmyk", 4)}


@dataclass
class Raster:
    """Samples as rows, columns and channels; bitonal and indexed ones have one channel."""

    kind: str
    data: np.ndarray

    @property
    def size(self) -> tuple[int, int]:
        return self.data.shape[1], self.data.shape[0]

    def packed(self) -> bytes:
        return np.packbits(self.data[:, :, 0] > 0, axis=1).tobytes() if self.kind == "bitonal" else self.data.tobytes()


def decode_image(doc: Document, stream: Stream) -> Raster | str:
    """The raster of an image, or why it is kept."""
    d = stream.dict
    w, h, bits = (doc.get(d, k) for k in (b"Width", b"Height", b"BitsPerComponent"))
    if not all(isinstance(v, int) and v > 0 for v in (w, h)):
        return "bad size"
    stencil = doc.get(d, b"ImageMask") is True
    space, channels = "other", 0
    cs = doc.get(d, b"ColorSpace")
    if stencil:
        space, channels, bits = "gray", 1, 1
    elif isinstance(cs, Name):
        space, channels = SPACES.get(bytes(cs), ("other", 0))
    elif isinstance(cs, list) and cs and cs[0] == b"Indexed":
        space, channels = "indexed", 1
    elif isinstance(cs, list) and len(cs) > 1 and cs[0] == b"ICCBased":
        space, channels = {1: ("gray", 1), 3: ("rgb", 3), 4: ("cmyk", 4)}.get(doc.get(cs[1], b"N"), ("other", 0))
    mapping = None
    try:
        if not channels:
            mapping = Space(doc, d.get(b"ColorSpace"))
            space, channels = mapping.kind, mapping.channels
        body = content_of(doc, stream)
    except (FormatError, KeyError, TypeError, ValueError, IndexError) as e:
        return str(e) if isinstance(e, FormatError) else "color space"
    decode = [doc.resolve(v) for v in doc.get(d, b"Decode") or []]
    if decode and not stencil and (mapping or space == "indexed" or len(decode) != 2 * channels):
        return "decode array"
    if bits not in (1, 2, 4, 8, 16):
        return "bits per component"
    stride = (w * channels * bits + 7) // 8
    if len(body) < stride * h:
        return "short data"
    rows = np.frombuffer(body[: stride * h], np.uint8).reshape(h, stride)
    if bits == 16:
        out = rows[:, ::2]
    elif bits == 8:
        out = rows
    else:
        each = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        out = (each * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        if space != "indexed" and not mapping:
            out = (out.astype(np.int64) * 255 // (2**bits - 1)).astype(np.uint8)
    out = out[:, : w * channels].reshape(h, w, channels)
    if mapping:
        try:
            return Raster(space, mapped(mapping, out, 8 if bits == 16 else bits))
        except FormatError as e:
            return f"color space: {e}"
    if decode and not stencil:
        low, high = (np.array(decode[k::2], float) for k in (0, 1))
        out = np.floor(np.clip(low + out / 255 * (high - low), 0, 1) * 255 + 0.5).astype(np.uint8)
    return Raster("bitonal" if bits == 1 and space == "gray" else space, out)


def reduce_raster(r: Raster) -> Raster:
    """One pixel if flat; gray if all are; two levels if there are no others."""
    data, kind = r.data, r.kind
    if data.shape[0] * data.shape[1] > 1 and (data == data[:1, :1]).all():
        data = data[:1, :1]
    if kind == "rgb" and (data[..., :1] == data).all():
        data, kind = data[..., :1], "gray"
    elif kind == "cmyk" and not data[..., :3].any():
        data, kind = 255 - data[..., 3:], "gray"
    if kind == "gray" and np.isin(data, (0, 255)).all():
        kind = "bitonal"
    return Raster(kind, np.ascontiguousarray(data))


def crop_raster(r: Raster, part: tuple) -> tuple[Raster, tuple] | None:
    w, h = r.size
    x0, x1 = max(0, int(np.floor(part[0] * w))), min(w, int(np.ceil(part[2] * w)))
    y0, y1 = max(0, int(np.floor((1 - part[3]) * h))), min(h, int(np.ceil((1 - part[1]) * h)))
    if x1 <= x0 or y1 <= y0 or (x0, y0, x1, y1) == (0, 0, w, h):
        return None
    return Raster(r.kind, np.ascontiguousarray(r.data[y0:y1, x0:x1])), (x0 / w, 1 - y1 / h, x1 / w, 1 - y0 / h)


def _weights(n: int, m: int, kernel: str) -> np.ndarray:
    """m rows of weights over n samples, each summing to one."""
    scale = n / m
    centre, at = (np.arange(m) + 0.5) * scale, np.arange(n) + 0.5
    x = (at[None, :] - centre[:, None]) / max(scale, 1.0)
    if kernel == "nearest":
        out = np.zeros((m, n))
        out[np.arange(m), np.minimum(n - 1, np.floor(centre).astype(int))] = 1
        return out
    if kernel == "box":
        lo, hi = np.arange(m)[:, None] * scale, (np.arange(m)[:, None] + 1) * scale
        out = np.clip(np.minimum(hi, at[None, :] + 0.5) - np.maximum(lo, at[None, :] - 0.5), 0, None)
    else:
        out = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return out / out.sum(axis=1, keepdims=True)


def resize_raster(r: Raster, w: int, h: int) -> Raster | None:
    """Lanczos for tones, the nearest sample for palette numbers; for two levels areas, in which the rarer one keeps 3 parts in 10."""
    if (w, h) == r.size or not w or not h:
        return None
    kernel = {"indexed": "nearest", "bitonal": "box"}.get(r.kind, "lanczos")
    across, down = _weights(r.size[0], w, kernel), _weights(r.size[1], h, kernel)
    out = np.einsum("yj,jic,xi->yxc", down, r.data.astype(float), across, optimize=True)
    if r.kind == "bitonal":
        black = (r.data == 0).sum() * 2 <= r.data.size
        share = 255 - np.round(out) if black else np.round(out)
        return Raster("bitonal", np.where((share >= int(255 * 0.3)) == black, 0, 255).astype(np.uint8))
    return Raster(r.kind, np.clip(np.round(out), 0, 255).astype(np.uint8))


def predicted(r: Raster) -> bytes:
    """Rows after the PNG filter of least absolute sum, each led by its number."""
    if r.kind == "bitonal":
        rows, step = np.packbits(r.data[:, :, 0] > 0, axis=1), 1
    else:
        rows, step = r.data.reshape(r.data.shape[0], -1), r.data.shape[2]
    rows = rows.astype(np.int64)
    up = np.vstack([np.zeros((1, rows.shape[1]), np.int64), rows[:-1]])
    shift = lambda v: np.hstack([np.zeros((len(v), step), np.int64), v[:, :-step]])[:, : v.shape[1]] if v.shape[1] > step else np.zeros_like(v)
    left, corner = shift(rows), shift(up)
    near = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
    guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
    each = np.stack([(rows - g) & 255 for g in (0, left, up, (left + up) // 2, guess)])
    cost = np.where(each > 127, 256 - each, each).sum(axis=2)
    best = cost.argmin(axis=0)
    return np.hstack([best[:, None], each[best, np.arange(len(rows))]]).astype(np.uint8).tobytes()


def encode_image(r: Raster, codecs: tuple[str, ...] = ("flate", "g4")) -> tuple[bytes, dict] | None:
    """The smallest of flate without and with prediction and, for two levels, fax coding, as codecs allow (of equal ones the first); None if none does."""
    head = {b"BitsPerComponent": 1 if r.kind == "bitonal" else 8, b"Width": r.size[0], b"Height": r.size[1]}
    found = []
    if "flate" in codecs:
        flate = head | {b"Filter": Name(b"FlateDecode")}
        found.append((zlib.compress(r.packed(), 9), flate))
        found.append((zlib.compress(predicted(r), 9), flate | {b"DecodeParms": {b"Predictor": 15, b"Colors": r.data.shape[2], b"BitsPerComponent": head[b"BitsPerComponent"], b"Columns": r.size[0]}}))
    if "g4" in codecs and r.kind == "bitonal":
        found.append((encode_fax(r.data[:, :, 0] == 0), head | {b"Filter": Name(b"CCITTFaxDecode"), b"DecodeParms": {b"K": -1, b"Columns": r.size[0], b"Rows": r.size[1]}}))
    return min(found, key=lambda x: len(x[0]), default=None)


def cmyk_raster_to_rgb(r: Raster) -> Raster:
    """Each color the mean of the overprints, weighted by the area that each covers."""
    inks = r.data.astype(float)[..., :, None] / 255
    areas = np.ones((*r.data.shape[:2], 1))
    for i in range(4):  # the first ink is the least bit of an overprint's number
        areas = np.concatenate([areas * (1 - inks[:, :, i]), areas * inks[:, :, i]], axis=2)
    return Raster("rgb", np.clip(np.floor(areas @ np.array(OVERPRINTS) * 255 + 0.5), 0, 255).astype(np.uint8))


def _codecs(preset: dict, kind: str) -> tuple[str, ...]:
    return tuple(preset[kind if kind in ("bitonal", "indexed") else "continuous"].split(","))


def recompress_images(doc: Document, preset: dict, usage: Usage, report: Report) -> None:
    masks = {m for x in doc.objects.values() if isinstance(x, Stream) for m in (x.dict.get(b"SMask"), x.dict.get(b"Mask")) if isinstance(m, Ref)}
    for ref in sorted(doc.objects):
        stream = doc.objects.get(ref)
        if not isinstance(stream, Stream) or doc.get(stream, b"Subtype") != b"Image" or ref in masks:
            continue
        row = {"num": ref.num, "gen": ref.gen, "width": doc.get(stream, b"Width"), "height": doc.get(stream, b"Height"), "bytes_in": len(stream.data), "bytes_out": len(stream.data)}
        try:
            row["action"] = _image(doc, ref, stream, preset, usage, row)
        except Exception as e:  # noqa: BLE001  one image never stops the document
            row["action"] = f"kept: {type(e).__name__}"
        report.images.append(row)


def _image(doc: Document, ref: Ref, stream: Stream, preset: dict, usage: Usage, row: dict) -> str:
    raster = decode_image(doc, stream)
    if isinstance(raster, str):
        return f"kept: {raster}"
    if not any(_codecs(preset, raster.kind)):
        return "kept: class excluded"
    d, steps, part = stream.dict, [], None
    mapped_ = isinstance(cs := doc.get(d, b"ColorSpace"), list) and cs[:1] not in ([b"Indexed"], [b"ICCBased"])
    if mapped_:
        steps.append("alternate")
    soft = _soft_mask(doc, ref)
    keyed, stencil = isinstance(doc.get(d, b"Mask"), list), doc.get(d, b"ImageMask") is True
    dpi = row["dpi"] = usage.resolution(ref, *raster.size)
    indexed, masked = raster.kind == "indexed", isinstance(doc.get(d, b"SMask") or doc.get(d, b"Mask"), Stream)
    d = doc.resolve(ref).dict
    mask = _Mask(doc, ref) if masked else None
    follows = mask is None or mask.raster is not None
    tiny = raster.size[0] * raster.size[1] < TINY
    profile = isinstance(doc.get(d, b"ColorSpace"), list) and not indexed and not mapped_
    if preset["reduce"] and not (keyed or stencil or profile or masked):
        less = reduce_raster(raster)
        if less.kind != raster.kind or less.size != raster.size:
            raster = less
            steps.append("reduced")
    seen = usage.crop(ref)
    if preset["clip"] and seen and follows:
        cut = crop_raster(raster, seen)
        total = raster.size[0] * raster.size[1]
        kept = cut[0].size[0] * cut[0].size[1] if cut else total
        if cut and kept * 16 <= total * 15 and len(stream.data) * (total - kept) // total > WRAPPER:
            raster, part = cut
            steps.append("clipped")
    if dpi and preset["threshold"] >= 0 and dpi > preset["threshold"] and not (keyed or tiny) and follows:
        factor = preset["target"] / dpi
        small = resize_raster(raster, *(max(1, int(np.floor(n * factor + 0.5))) for n in raster.size))
        if small:
            raster = small
            steps.append("downsampled")
    if preset["rgb"] and raster.kind == "cmyk" and not (keyed or profile):
        raster = cmyk_raster_to_rgb(raster)
        steps.append("rgb")
    # what the image has become decides on the codecs
    made = encode_image(raster, _codecs(preset, raster.kind))
    if made is None:
        return "kept: no codec at hand" + soft
    body, head = made
    if len(body) >= len(stream.data):
        return "kept: not smaller" + soft
    new = {k: v for k, v in d.items() if k not in (b"Decode", b"DecodeParms", b"DP", b"F", b"SMaskInData") or (k == b"Decode" and stencil)} | head
    if not stencil and not indexed and not profile:
        new[b"ColorSpace"] = Name({"bitonal": b"DeviceGray", "gray": b"DeviceGray", "rgb": b"DeviceRGB", "cmyk": b"DeviceCMYK"}[raster.kind])
    doc.objects[ref] = Stream(new, body)
    if mask and mask.raster is not None and (part or "downsampled" in steps):
        mask.follow(part, raster.size)
    if part:
        _wrap(doc, ref, part)
    row["bytes_out"] = len(body)
    return ("+".join(steps) or "recoded") + soft


class _Mask:
    """An image's own mask, which is cut and resized as the image is; raster is None where it can't be."""

    def __init__(self, doc: Document, ref: Ref):
        d = doc.resolve(ref).dict
        self.doc, self.ref = doc, d.get(b"SMask") if b"SMask" in d else d.get(b"Mask")
        stream = doc.resolve(self.ref)
        users = sum(isinstance(x, Stream) and self.ref in (x.dict.get(b"SMask"), x.dict.get(b"Mask")) for x in doc.objects.values())
        raster = decode_image(doc, stream) if isinstance(self.ref, Ref) and users == 1 and b"Matte" not in stream.dict else ""
        self.raster = raster if isinstance(raster, Raster) else None

    def follow(self, part: tuple | None, size: tuple[int, int]) -> None:
        raster = self.raster
        if part and (cut := crop_raster(raster, part)):
            raster = cut[0]
        if raster.size[0] > size[0] and raster.size[1] > size[1]:
            raster = resize_raster(raster, *size) or raster
        body, head = encode_image(raster)
        old = self.doc.resolve(self.ref)
        self.doc.objects[self.ref] = Stream({k: v for k, v in old.dict.items() if k not in (b"DecodeParms", b"DP", b"F")} | head, body)


def _soft_mask(doc: Document, ref: Ref) -> str:
    """A soft mask that hides nothing goes; one of two levels becomes a stencil, in which ones hide."""
    d = doc.resolve(ref).dict
    mask = doc.resolve(d.get(b"SMask"))
    if not isinstance(mask, Stream) or b"Matte" in mask.dict or not isinstance(d.get(b"SMask"), Ref):
        return ""
    raster = decode_image(doc, mask)
    if isinstance(raster, str) or raster.kind not in ("gray", "bitonal"):
        return ""
    if (raster.data == 255).all():
        d.pop(b"SMask")
        return "+smask-removed"
    if np.isin(raster.data, (0, 255)).all():
        body, head = encode_image(Raster("bitonal", 255 - raster.data))
        if len(body) < len(mask.data):
            d[b"Mask"] = doc.add(Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"ImageMask": True} | head, body))
            d.pop(b"SMask")
            return "+smask-stencil"
    return ""


def _wrap(doc: Document, ref: Ref, part: tuple) -> None:
    """A form in the image's place that draws it into its part of the unit square."""
    image = doc.add(doc.objects[ref])
    x0, y0, x1, y1 = part
    content = f"q {x1 - x0:.6g} 0 0 {y1 - y0:.6g} {x0:.6g} {y0:.6g} cm /Im Do Q".encode()
    head = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 1, 1], b"Resources": {b"XObject": {b"Im": image}}}
    doc.objects[ref] = Stream(head, content)


# ---- fonts


def _programs(doc: Document) -> dict[Ref, tuple[bytes, list[tuple[Ref, dict]]]]:
    """Embedded programs with their key and the simple fonts that use them, in order of the fonts."""
    out: dict[Ref, tuple[bytes, list[tuple[Ref, dict]]]] = {}
    for ref in sorted(doc.objects):
        font = doc.objects[ref]
        if isinstance(font, dict) and font.get(b"Type") == b"Font" and font.get(b"Subtype") not in (b"Type3", b"Type0", b"CIDFontType0", b"CIDFontType2"):
            holder = doc.get(font, b"FontDescriptor")
            for key in (b"FontFile", b"FontFile2", b"FontFile3"):
                if isinstance(holder, dict) and isinstance(program := holder.get(key), Ref) and isinstance(doc.resolve(program), Stream):
                    out.setdefault(program, (key, []))[1].append((ref, holder))
    return out


def _default_fonts(doc: Document) -> set[Ref]:
    """Fonts that default appearances name, or that draw glyphs of other fonts: these stay as they are."""
    names, out = set(), set()
    for x in doc.objects.values():
        if isinstance(x, dict) and isinstance(da := doc.resolve(x.get(b"DA")), Text):
            words = re.split(rb"[ \t\n\r\f\0]", bytes(da))
            names |= {a[1:] for a, _, c in zip(words, words[1:], words[2:], strict=False) if c == b"Tf" and a.startswith(b"/")}
    for x in doc.objects.values():
        d = x.dict if isinstance(x, Stream) else x
        if isinstance(d, dict):
            defaults = doc.get(doc.get(d, b"DR"), b"Font") or {}
            out |= {r for n, r in defaults.items() if n in names and isinstance(r, Ref)}
            if d.get(b"Subtype") == b"Type3":
                out |= {r for r in (doc.get(doc.get(d, b"Resources"), b"Font") or {}).values() if isinstance(r, Ref)}
    return out


def _replaceable(doc: Document, font: dict, holder: dict) -> str | None:
    """The standard font that a viewer's own copy can stand in for."""
    name = doc.get(font, b"BaseFont")
    standard = standard_font_of(name.decode("latin-1")) if isinstance(name, Name) else None
    if standard is None:
        return None
    encoding, symbolic = doc.get(font, b"Encoding"), bool((doc.get(holder, b"Flags") or 0) & 4)
    if standard in ("Symbol", "ZapfDingbats"):
        return standard if encoding is None else None
    if encoding is None:
        return None if symbolic else standard
    if isinstance(encoding, dict):
        given = doc.get(encoding, b"Differences") or []
        known = all(isinstance(x, int) or isinstance(x, Name) and character(x.decode("latin-1")) is not None for x in given)
        encoding = (doc.get(encoding, b"BaseEncoding") or Name(b"StandardEncoding")) if known else None
    return standard if isinstance(encoding, Name) and encoding.decode("latin-1") in STANDARD_ENCODINGS else None


def convert_fonts(doc: Document, preset: dict, report: Report) -> None:
    """Standard fonts lose their programs; Type 1 programs become compact ones where that is smaller."""
    kept = _default_fonts(doc)
    for program, (key, fonts) in _programs(doc).items():
        stream = doc.resolve(program)
        row = {"num": program.num, "gen": program.gen, "name": bytes(doc.get(fonts[0][0], b"BaseFont") or b"").decode("latin-1"), "program": key.decode(), "bytes_in": len(stream.data), "bytes_out": len(stream.data), "action": "kept"}
        report.fonts.append(row)
        standard = [_replaceable(doc, doc.objects[ref], holder) for ref, holder in fonts]
        if any(ref in kept for ref, _ in fonts):
            row["action"] = "kept: default appearance"
        elif preset["unembed"] and all(standard):
            for (ref, holder), name in zip(fonts, standard, strict=True):
                holder.pop(key, None)
                doc.objects[ref][b"BaseFont"] = holder[b"FontName"] = Name(name.encode())
            row |= {"action": "unembedded", "bytes_out": 0}
        elif preset["cff"] and key == b"FontFile":
            try:
                packed = zlib.compress(to_compact(content_of(doc, stream)), 9)
            except (FormatError, ValueError, OverflowError) as e:
                row["action"] = f"kept: {e}"
                continue
            if len(packed) >= len(stream.data):
                row["action"] = "kept: not smaller"
                continue
            doc.objects[program] = Stream({b"Subtype": Name(b"Type1C"), b"Filter": Name(b"FlateDecode")}, packed)
            for _, holder in fonts:
                holder[b"FontFile3"] = holder.pop(key, program)
            row |= {"action": "converted to CFF", "bytes_out": len(packed)}


# ---- stripping and structure


def strip(doc: Document, names: str) -> int:
    on = {n for n in names.split(",") if n}
    keys = lambda kind: [k.encode() for where, flag, k in STRIP_RULES if where == kind and flag in on]
    root = doc.resolve(doc.trailer.get(b"Root"))
    removed = 0
    for x in doc.objects.values():
        d = x.dict if isinstance(x, Stream) else x
        if not isinstance(d, dict):
            continue
        gone = list(keys("catalog")) if d is root else []
        if isinstance(x, Stream) or b"Type" in d:
            gone += keys("object")
        if isinstance(x, dict) and d.get(b"Type") == b"Page":
            gone += keys("page")
        if isinstance(x, Stream) and d.get(b"Subtype") == b"Image":
            gone += keys("image")
        for k in set(gone) & set(d):
            del d[k]
            removed += 1
    return removed


_NUMBER = re.compile(rb"([+-]?)0*(\d*)(?:\.(\d*?)0*)?")


def canonical_content(content: bytes) -> bytes | None:
    """The same operations with the least white space and the shortest numbers; None for inline images and what can't be parsed."""
    try:
        before = operations(content)
    except FormatError:
        return None
    if any(op == b"BI" for op, _ in before):
        return None
    tokens, p = [], Parser(content, keywords=True)
    while not p.done():
        start = p.at
        if content[start : start + 2] in (b"<<", b">>"):
            p.at += 2
        elif content[start : start + 1] in (b"[", b"]"):
            p.at += 1
        else:
            p.value()
        raw = content[start : p.at]
        if raw[:1] == b"<" and raw[:2] != b"<<":
            raw = re.sub(rb"[\0\t\n\f\r ]", b"", raw)
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", raw):
            sign, a, b = _NUMBER.fullmatch(raw).groups()
            raw = ((b"-" if sign == b"-" and (a or b) else b"") + a + (b"." + b if b else b"")) or b"0"
        tokens.append(raw)
    out, free = bytearray(), True
    for t in tokens:
        regular = t[:1] not in b"/<([])>"
        if regular and not free:
            out += b" "
        out += t
        free = t[-1:] in b">])" and t[:1] != b"/"
    try:
        same = operations(bytes(out)) == before
    except FormatError:
        same = False
    return bytes(out) if same else None


def rebuild_content(doc: Document) -> tuple[int, int]:
    """Streams rewritten and bytes saved, where the canonical form packs smaller."""
    refs = set()
    for page in pages_of(doc):
        parts = doc.resolve(page).get(b"Contents")
        inner = doc.resolve(parts)
        refs |= {r for r in ([parts] if isinstance(inner, Stream) else inner or []) if isinstance(r, Ref)}
    refs |= {r for r, x in doc.objects.items() if isinstance(x, Stream) and (x.dict.get(b"Subtype") == b"Form" or x.dict.get(b"PatternType") == 1)}
    n = saved = 0
    for ref in sorted(refs):
        stream = doc.objects.get(ref)
        if not isinstance(stream, Stream):
            continue
        try:
            content = content_of(doc, stream)
        except FormatError:
            continue
        new = canonical_content(content) if len(content) <= REBUILT else None
        packed = zlib.compress(new, 9) if new is not None else b""
        if new is not None and len(packed) < len(stream.data):
            saved += len(stream.data) - len(packed)
            n += 1
            head = {k: v for k, v in stream.dict.items() if k not in (b"DecodeParms", b"DP", b"F")} | {b"Filter": Name(b"FlateDecode")}
            doc.objects[ref] = Stream(head, packed)
    return n, saved


_USES = {b"Do": (b"XObject", 0), b"Tf": (b"Font", 0), b"gs": (b"ExtGState", 0), b"cs": (b"ColorSpace", 0), b"CS": (b"ColorSpace", 0), b"scn": (b"Pattern", -1), b"SCN": (b"Pattern", -1), b"sh": (b"Shading", 0), b"BDC": (b"Properties", 1), b"DP": (b"Properties", 1)}


def prune_resources(doc: Document) -> int:
    """Removes entries of resource dictionaries that no owner uses; shared dictionaries keep what any owner uses."""
    keep: dict[int, set[bytes] | None] = {}
    found: dict[int, dict] = {}
    owners = [(p, page_content(doc, p)) for p in pages_of(doc) if b"Resources" in doc.resolve(p)]
    forms = []
    for ref, x in doc.objects.items():
        if isinstance(x, Stream) and (x.dict.get(b"Subtype") == b"Form" or x.dict.get(b"PatternType") == 1):
            try:
                forms.append((ref, content_of(doc, x)))
            except FormatError:
                forms.append((ref, None))
    lent = {id(doc.resolve(d.get(b"Resources"))) for d in (doc.resolve(r) for r in doc.objects) if isinstance(d, dict) and b"Kids" in d}
    bare = any(b"Resources" not in doc.objects[r].dict for r, _ in forms)
    for ref, content in [*owners, *forms]:
        x = doc.objects[ref]
        res = doc.resolve((x.dict if isinstance(x, Stream) else x).get(b"Resources"))
        if not isinstance(res, dict):
            continue
        try:
            ops = operations(content) if content is not None else None
        except FormatError:
            ops = None
        for category, entries in res.items():
            entries = doc.resolve(entries)
            if category == b"ProcSet" or not isinstance(entries, dict):
                continue
            found[id(entries)] = entries
            whole = ops is None or bare or id(res) in lent or (category == b"ColorSpace" and any(op == b"BI" for op, _ in ops))
            used = set() if ops is None else {bytes(a[at]) for op, a in ops for c, at in [_USES.get(op, (b"", 0))] if c == category and len(a) > (at if at > 0 else 0) and isinstance(a[at], Name)}
            before = keep.get(id(entries), set())
            keep[id(entries)] = None if whole or before is None else before | used
    for x in doc.objects.values():  # default resources of forms, fonts that draw their glyphs
        d = x.dict if isinstance(x, Stream) else x
        for holder in ([doc.get(d, b"DR")] if isinstance(d, dict) and b"DR" in d else []) + ([doc.get(d, b"Resources")] if isinstance(d, dict) and d.get(b"Subtype") == b"Type3" else []):
            for entries in map(doc.resolve, (holder or {}).values()):
                if id(entries) in keep:
                    keep[id(entries)] = None
    removed = 0
    for key, names in keep.items():
        if names is not None:
            for name in set(found[key]) - names:
                del found[key][name]
                removed += 1
    return removed


def mergeable(x) -> bool:
    if isinstance(x, Stream):
        return x.dict.get(b"Type") not in (b"ObjStm", b"XRef")
    return isinstance(x, dict) and x.get(b"Type") not in (b"Page", b"Pages", b"Catalog", b"Annot") and not {b"Parent", b"Kids", b"P"} & set(x)


def repoint(x, remap: dict):
    if isinstance(x, Ref):
        return remap.get(x, x)
    if isinstance(x, list):
        return [repoint(v, remap) for v in x]
    if isinstance(x, Stream):
        return Stream(repoint(x.dict, remap), x.data)
    if isinstance(x, dict):
        return {k: repoint(v, remap) for k, v in x.items()}
    return x


def merge_equal(doc: Document) -> int:
    merged = 0
    for _ in range(PASSES):
        first, remap = {}, {}
        for ref in sorted(doc.objects):
            if mergeable(doc.objects[ref]):
                keep = first.setdefault(canonical(doc.objects[ref]), ref)
                if keep != ref:
                    remap[ref] = keep
        if not remap:
            break
        merged += len(remap)
        doc.objects = {r: repoint(x, remap) for r, x in doc.objects.items() if r not in remap}
        doc.trailer = repoint(doc.trailer, remap)
    return merged


def drop_dangling(doc: Document) -> int:
    n = 0

    def clean(x):
        nonlocal n
        if isinstance(x, Stream):
            return Stream(clean(x.dict), x.data)
        if isinstance(x, (dict, list)):
            items = list(x.items()) if isinstance(x, dict) else list(enumerate(x))
            live = [(k, v) for k, v in items if not isinstance(v, Ref) or v in doc.objects]
            n += len(items) - len(live)
            return {k: clean(v) for k, v in live} if isinstance(x, dict) else [clean(v) for _, v in live]
        return x

    doc.objects = {r: clean(x) for r, x in doc.objects.items()}
    doc.trailer = clean(doc.trailer)
    return n


def pack_streams(doc: Document) -> None:
    for ref, x in doc.objects.items():
        if isinstance(x, Stream) and b"Filter" not in x.dict and b"F" not in x.dict and len(packed := zlib.compress(x.data, 9)) < len(x.data):
            doc.objects[ref] = Stream(x.dict | {b"Filter": Name(b"FlateDecode")}, packed)


def renumber(doc: Document) -> None:
    live = sorted(reachable(doc))
    remap = {r: Ref(i + 1, 0) for i, r in enumerate(live)}
    doc.objects = {remap[r]: repoint(doc.objects[r], remap) for r in live}
    doc.trailer = repoint(doc.trailer, remap)


def structure(doc: Document, report: Report) -> None:
    n, saved = rebuild_content(doc)
    unused = prune_resources(doc)
    pack_streams(doc)
    merged, gone = merge_equal(doc), drop_dangling(doc)
    renumber(doc)
    report.notes += [f"{text}: {k}" for text, k in (("content streams rebuilt", n), ("bytes saved in content", saved), ("unused resources", unused), ("objects merged", merged), ("dangling references", gone)) if k]


# ---- verification


def verify(data: bytes, pages: int) -> list[str]:
    """Problems of a file: whether it parses, its pages, their content, every stream that needs no image codec."""
    try:
        doc = read(data)
    except FormatError as e:
        return [f"does not parse: {e}"]
    out = []
    found = pages_of(doc)
    if len(found) != pages:
        out.append(f"page count is {len(found)}, not {pages}")
    for n, page in enumerate(found):
        content = page_content(doc, page)
        try:
            if content is None:
                raise FormatError("a filter fails")
            operations(content)
        except FormatError as e:
            out.append(f"page {n}: content stream: {e}")
    for ref, x in doc.objects.items():
        if isinstance(x, Stream):
            try:
                content_of(doc, x)
            except FormatError as e:
                if not str(e).startswith("filter "):
                    out.append(f"object {ref.num}: stream: {e}")
    return out


def regressed(found: list[str], before: list[str]) -> list[tuple[str, int, int]]:
    """Categories of problems that now are more than before: category, now, before."""
    now, was = (Counter(category_of(p) for p in x) for x in (found, before))
    return [(c, n, was[c]) for c, n in now.items() if n > was[c]]


# ---- all of it


def enabled(p: dict) -> dict[str, bool]:
    """Which stages a preset runs."""
    codecs = any(p[k] for k in ("bitonal", "continuous", "indexed"))
    return {"usage": p["threshold"] >= 0 or p["clip"] or p["subset"], "images": codecs, "fonts": p["subset"] or p["cff"] or p["unembed"], "strip": bool(p["strip"]), "structure": True}


def compress(data: bytes, preset: str | dict, check: bool = True) -> tuple[bytes, Report, str | None]:
    """The smaller file by a preset or settings of that shape, what was done, and why it was refused, if it was; a refused or grown file is given back as it was."""
    report, p = Report(), PRESETS[preset] if isinstance(preset, str) else preset
    try:
        doc = read(data)
        pages = len(pages_of(doc))
        guard(doc)
    except FormatError as e:
        return data, report, f"does not parse: {e}"
    except Refusal as e:
        return data, report, str(e)
    normalize(doc)
    on, before = enabled(p), len(data)
    usage = Usage(doc, on["usage"])
    stages = {
        "images": lambda: recompress_images(doc, p, usage, report),
        "fonts": lambda: convert_fonts(doc, p, report),
        "strip": lambda: report.notes.extend([f"entries stripped: {n}"] if (n := strip(doc, p["strip"])) else []),
        "structure": lambda: structure(doc, report),
    }
    for name, run in stages.items():
        began, after = time.perf_counter(), before
        if on[name]:
            run()
            after = len(smaller(doc)[0])
        report.stages.append({"stage_no": len(report.stages), "name": name, "bytes_before": before, "bytes_after": after, "elapsed_ms": (time.perf_counter() - began) * 1e3})
        before = after
    out, form = smaller(doc, data)
    if form == "kept":
        report.notes.append("output would not be smaller; the input is kept")
    elif check and (found := verify(out, pages)):
        if new := regressed(found, verify(data, pages)):
            return data, report, "rejected: " + ", ".join(f"{c} {n}, was {was}" for c, n, was in new)
        report.notes += [f"the input has this too: {x}" for x in found[:PROBLEMS]]
    return out, report, None
