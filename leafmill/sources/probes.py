"""One-page documents that each vary one thing, built from nothing."""

from __future__ import annotations

import os

import numpy as np

from leafmill.sources.objects import Document, Name, Ref, Stream, Text, write


def page(content: bytes, resources: dict | None = None, size=(300, 300), extra: dict | None = None) -> Document:
    doc = Document()
    tree, leaf, body = Ref(2, 0), Ref(3, 0), Ref(4, 0)
    doc.objects = {
        Ref(1, 0): {b"Type": Name(b"Catalog"), b"Pages": tree},
        tree: {b"Type": Name(b"Pages"), b"Kids": [leaf], b"Count": 1},
        leaf: {b"Type": Name(b"Page"), b"Parent": tree, b"MediaBox": [0, 0, *size], b"Contents": body, b"Resources": resources or {}} | (extra or {}),
        body: Stream({}, content),
    }
    doc.trailer = {b"Root": Ref(1, 0)}
    return doc


def image(doc: Document, data: np.ndarray, space=b"DeviceRGB", bits=8, **head) -> Ref:
    h, w = data.shape[:2]
    body = np.packbits(data > 0, axis=1).tobytes() if bits == 1 else data.astype(np.uint8).tobytes()
    d = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": w, b"Height": h, b"BitsPerComponent": bits, b"ColorSpace": Name(space) if isinstance(space, bytes) else space}
    return doc.add(Stream(d | {k.encode(): v for k, v in head.items()}, body))


def with_image(data: np.ndarray, content=b"q 72 0 0 72 10 10 cm /Im Do Q", **kw) -> Document:
    doc = page(content)
    doc.objects[Ref(3, 0)][b"Resources"] = {b"XObject": {b"Im": image(doc, data, **kw)}}
    return doc


def photo(w=200, h=160, channels=3, seed=0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([(x + k * 40) % 256 + y // 2 for k in range(channels)], axis=2)
    return np.clip(base + rng.integers(0, 9, (h, w, channels)), 0, 255).astype(np.uint8)


def probes() -> dict[str, bytes]:
    out: dict[str, Document] = {}
    gray = np.repeat(photo(300, 300, 1), 3, axis=2)
    out["gray-rgb-300dpi"] = with_image(gray)
    lines = np.zeros((600, 1200), np.uint8) + 255
    lines[::12, :] = 0
    out["bitonal-lines"] = with_image(lines, content=b"q 144 0 0 72 10 10 cm /Im Do Q", space=b"DeviceGray", bits=1)
    palette = Text(bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]))
    out["indexed"] = with_image((np.indices((300, 400)).sum(0) // 30 % 4).astype(np.uint8), content=b"q 96 0 0 72 0 0 cm /Im Do Q", space=[Name(b"Indexed"), Name(b"DeviceRGB"), 3, palette])
    out["clipped"] = with_image(photo(400, 400, 1), content=b"q 0 0 100 200 re W n 200 0 0 200 0 0 cm /Im Do Q", space=b"DeviceGray")
    out["cmyk"] = with_image(photo(100, 100, 4), space=b"DeviceCMYK")
    twice = page(b"q 50 0 0 50 0 0 cm /A Do Q q 50 0 0 50 60 0 cm /B Do Q")
    a, b = (image(twice, photo(100, 100, 1), b"DeviceGray") for _ in range(2))
    twice.objects[Ref(3, 0)][b"Resources"] = {b"XObject": {b"A": a, b"B": b}}
    out["duplicates"] = twice
    unused = with_image(photo(80, 80))
    res = unused.objects[Ref(3, 0)][b"Resources"]
    res[b"XObject"][b"Never"] = image(unused, photo(80, 80, seed=3))
    res[b"Font"] = {b"F9": unused.add({b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Helvetica")})}
    out["unused"] = unused
    meta = page(b"0 0 m 10 10 l S")
    meta.objects[Ref(1, 0)][b"Metadata"] = meta.add(Stream({b"Type": Name(b"Metadata")}, b"<x>" + b"m" * 2000 + b"</x>"))
    meta.objects[Ref(3, 0)][b"Thumb"] = image(meta, photo(16, 16))
    out["metadata"] = meta
    out["verbose"] = page(b"\n".join(b"  %03d.500  %d   50.00  +050  re  %% comment\n f" % (i, i) for i in range(40)))
    out["inline"] = page(b"q 10 0 0 10 0 0 cm BI /W 2 /H 2 /BPC 8 /CS /G ID abcd EI Q")
    form = page(b"q 2 0 0 2 0 0 cm /Fm Do Q /T 12 Tf (hello) Tj")
    im = image(form, photo(144, 144))
    font = form.add({b"Type": Name(b"Font"), b"Subtype": Name(b"Type1"), b"BaseFont": Name(b"Arial")})
    inner = form.add(Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Form"), b"BBox": [0, 0, 100, 100], b"Matrix": [1, 0, 0, 1, 5, 5], b"Resources": {b"XObject": {b"Im": im}}}, b"72 0 0 36 0 0 cm /Im Do"))
    form.objects[Ref(3, 0)][b"Resources"] = {b"XObject": {b"Fm": inner}, b"Font": {b"T": font}}
    out["form"] = form
    return {name: write(doc, False) for name, doc in out.items()}


def damaged() -> dict[str, bytes]:
    """Documents that must be refused, and one that doesn't parse."""
    out = {"junk": b"not a document"}
    tree = with_image(photo(60, 50))
    tree.objects[Ref(2, 0)][b"Kids"].append(Ref(99, 0))
    out["lost-page"] = write(tree, False)
    body = page(b"0 0 m")
    del body.objects[Ref(4, 0)]
    out["lost-content"] = write(body, False)
    locked = page(b"0 0 m")
    locked.add({b"Filter": Name(b"Standard"), b"V": 1, b"R": 2})
    out["locked"] = write(locked, False).replace(b"/Root", b"/Encrypt 5 0 R/Root", 1)
    return out


def save(folder: str) -> list[str]:
    """Writes every probe below folder; their names."""
    os.makedirs(folder, exist_ok=True)
    made = probes()
    for name, data in made.items():
        with open(os.path.join(folder, f"{name}.pdf"), "wb") as f:
            f.write(data)
    return sorted(made)
