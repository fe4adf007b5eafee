import struct

import pytest

from leafmill.functions import jpeg
from leafmill.sources.objects import FormatError


def made(adobe=None, kind=0xC0, channels=3):
    part = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0") + (part(0xEE, b"Adobe\0\x64\0\0\0\0" + bytes([adobe])) if adobe is not None else b"")
    return out + b"\xff" + part(kind, struct.pack(">BHHB", 8, 20, 30, channels) + b"\0" * 9) + part(0xDA, b"x") + b"data"


def test_info():
    got = jpeg.info(made(adobe=2, kind=0xC2, channels=4))
    assert (got.width, got.height, got.channels, got.bits, got.progressive, got.adobe) == (30, 20, 4, 8, True, 2)
    assert jpeg.info(made()).adobe is None
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8abcd"):
        with pytest.raises(FormatError):
            jpeg.info(bad)


def test_transform():
    assert jpeg.transform(jpeg.info(made()), None) and not jpeg.transform(jpeg.info(made()), 0)
    assert not jpeg.transform(jpeg.info(made(channels=4)), None) and jpeg.transform(jpeg.info(made(adobe=2, channels=4)), 0) and not jpeg.transform(jpeg.info(made(adobe=0)), 1)
