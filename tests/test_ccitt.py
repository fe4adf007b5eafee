import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.sources import probes as make
from leafmill.functions import ccitt
from leafmill.operators import stages
from leafmill.sources.objects import Name, Stream, content_of, read, write


@pytest.mark.parametrize("color", [0, 1])
def test_no_word_begins_another(color):
    table = ccitt.runs()[color]
    assert sorted(table) == [*range(64), *range(64, 2561, 64)] and len(set(table.values())) == len(table)
    words = sorted(table.values())
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    modes = sorted([ccitt.PASS, ccitt.ACROSS, *ccitt.VERTICAL.values()])
    assert not any(b.startswith(a) for a, b in zip(modes, modes[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(0, 12), st.integers(0, 2**32 - 1), st.floats(0, 1))
def test_round_trip(width, height, seed, share):
    rng = np.random.default_rng(seed)
    black = rng.random((height, width)) < share
    for y in range(1, height):  # rows much like the one before
        if rng.random() < 0.6:
            black[y] = black[y - 1] ^ (rng.random(width) < 0.05)
    assert (ccitt.decode(ccitt.encode(black), width, height) == black).all()


def test_long_runs_and_likely_pages():
    page = np.zeros((40, 6000), bool)
    page[5:9, 100:5900] = True
    page[::7, ::3] = True
    data = ccitt.encode(page)
    assert (ccitt.decode(data, 6000) == page).all() and len(data) < page.size // 8
    blank = np.zeros((100, 1000), bool)
    assert len(ccitt.encode(blank)) < 20 and not ccitt.decode(ccitt.encode(blank), 1000, 100).any()
    with pytest.raises(ValueError):
        ccitt.decode(data[:40], 6000, 40)


def test_known_bytes():
    # one row of eight white pixels against a white line: one vertical mode, then the end
    assert ccitt.encode(np.zeros((1, 8), bool)) == bytes([0b10000000, 0b00001000, 0b00000000, 0b10000000])


def test_documents():
    lines = np.zeros((600, 1200), np.uint8) + 255
    lines[::12, ::2] = 0
    out, report, _ = stages.compress(make.probes()["bitonal-lines"], "standard")
    doc = read(out)
    image = next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image")
    assert stages.verify(out, 1) == [] and not report.images[0]["action"].startswith("kept")
    fax = make.with_image(lines, space=b"DeviceGray", bits=1)
    stream = next(x for x in fax.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image")
    want = stages.decode_image(fax, stream).data
    stream.dict |= {b"Filter": Name(b"CCITTFaxDecode"), b"DecodeParms": {b"K": -1, b"Columns": 1200, b"Rows": 600}}
    stream.data = ccitt.encode(lines == 0)
    again = read(write(fax, True))
    back = next(x for x in again.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image")
    assert (stages.decode_image(again, back).data == want).all()
    assert image is not None and len(content_of(doc, image)) > 0
