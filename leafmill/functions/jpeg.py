"""What a JPEG's markers say, without decoding it."""

from __future__ import annotations

from dataclasses import dataclass

from leafmill.sources.objects import FormatError

# Markers of frames, markers without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD9)}


@dataclass
class Info:
    width: int
    height: int
    channels: int
    bits: int
    progressive: bool
    adobe: int | None  # the transform that an Adobe marker names, if there is one


def info(data: bytes) -> Info:
    """Of the first frame; FormatError if there is none before the scan."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("no JPEG")
    at, adobe, frame = 2, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise FormatError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker in FRAMES and frame is None and len(body) >= 6:
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), body[5], body[0], marker in (0xC2, 0xC6, 0xCA, 0xCE))
        elif marker in (0xDA, 0xD9):
            break
        at += 2 + size
    if frame is None:
        raise FormatError("no frame")
    return Info(*frame, adobe)


def transform(found: Info, named: int | None) -> bool:
    """Whether channels are luma and chroma: an Adobe marker decides, else the document, else three channels are and four aren't."""
    if found.adobe is not None:
        return found.adobe != 0
    return named != 0 if named is not None else found.channels == 3
