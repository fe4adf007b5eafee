import numpy as np
import pytest

from leafmill.sources import probes as make
from leafmill.functions.mappings import Function, Space, mapped
from leafmill.operators import stages
from leafmill.sources.objects import FormatError, Name, Ref, Stream, read, write


def fn(d: dict, data: bytes | None = None) -> Function:
    d = {k.encode(): v for k, v in d.items()}
    return Function(make.page(b"q Q"), d if data is None else Stream(d, data))


def test_exponential_and_stitched():
    square = {b"FunctionType": 2, b"Domain": [-1, 1], b"C0": [1], b"C1": [3], b"N": 2}
    f = fn({"FunctionType": 2, "Domain": [-1, 1], "C0": [1], "C1": [3], "N": 2})
    assert f(np.array([[0.5], [-0.5], [9.0]])).tolist() == [[1.5], [0.5], [3.0]]
    g = fn({"FunctionType": 3, "Domain": [0, 1], "Functions": [square, square], "Bounds": [0.5], "Encode": [0, 1, 1, 0]})
    assert g(np.array([[0.0], [0.25], [0.5], [1.0]])).tolist() == [[1.0], [1.5], [3.0], [1.0]]


def test_sampled_in_two_inputs():
    f = fn({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 255, 255, 0]))
    assert np.allclose(f(np.array([[0, 0], [1, 0], [0, 1], [1, 1], [0.5, 0.5], [0.25, 0]]))[:, 0], [0, 1, 1, 0, 0.5, 0.25])
    packed = fn({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 15], "Size": [3], "BitsPerSample": 4}, bytes([0x0F, 0x30]))
    assert np.allclose(packed(np.array([[0.0], [0.25], [0.5], [1.0]]))[:, 0], [0, 7.5, 15, 3])


def test_programs_and_lists():
    f = fn({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1, 0, 1]}, b"{ dup 2 mul exch 1 exch sub }")
    assert f(np.array([[0.25], [0.75]])).tolist() == [[0.5, 0.75], [1.0, 0.25]]
    two = Function(make.page(b"q Q"), [{b"FunctionType": 2, b"Domain": [0, 1], b"N": 1}, {b"FunctionType": 2, b"Domain": [0, 1], b"C0": [1], b"C1": [0], b"N": 1}])
    assert two(np.array([[0.25]])).tolist() == [[0.25, 0.75]]
    for bad in ({"FunctionType": 2}, {"FunctionType": 9, "Domain": [0, 1]}, {"FunctionType": 3, "Domain": [0, 1], "Functions": [], "Bounds": [1]}):
        with pytest.raises(FormatError):
            fn(bad)
    with pytest.raises(FormatError):
        fn({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{ pop pop }")(np.array([[0.5]]))


TINT = {b"FunctionType": 2, b"Domain": [0, 1], b"C0": [0, 0, 0, 0], b"C1": [0.8, 0, 0, 0.2], b"N": 1}


def test_spaces():
    doc = make.page(b"q Q")
    spot = Space(doc, [Name(b"Separation"), Name(b"Spot"), Name(b"DeviceCMYK"), TINT])
    assert mapped(spot, np.array([[[255], [0]]], np.uint8), 8).tolist() == [[[204, 0, 0, 51], [0, 0, 0, 0]]]
    lab = Space(doc, [Name(b"Lab"), {b"WhitePoint": [0.9505, 1, 1.089]}])
    assert mapped(lab, np.array([[[255, 128, 128], [0, 128, 128]]], np.uint8), 8)[0, 0].min() >= 250
    with pytest.raises(FormatError):
        Space(doc, [Name(b"Pattern")])


def test_mapped_image_becomes_a_device_image():
    data = np.repeat(make.photo(150, 120, 1), 1, axis=2)
    out, report, _ = stages.compress(write_image(data, [Name(b"Separation"), Name(b"Spot"), Name(b"DeviceCMYK"), TINT]), "standard")
    assert report.images[0]["action"] in ("alternate", "alternate+downsampled", "kept: not smaller") and stages.verify(out, 1) == []


def write_image(data, space, mask=None) -> bytes:
    doc = make.with_image(data, space=space)
    if mask is not None:
        ref = make.image(doc, mask, b"DeviceGray")
        next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image").dict[b"SMask"] = ref
    return write(doc, False)


def test_soft_masks():
    opaque = np.full((100, 100, 1), 255, np.uint8)
    out, report, _ = stages.compress(write_image(make.photo(100, 100), b"DeviceRGB", opaque), "standard")
    assert report.images[0]["action"].endswith("+smask-removed") and b"SMask" not in b"".join(k for x in read(out).objects.values() if isinstance(x, Stream) for k in x.dict)
    half = opaque.copy()
    half[:50] = 0
    out, report, _ = stages.compress(write_image(make.photo(100, 100), b"DeviceRGB", half), "standard")
    assert report.images[0]["action"].endswith("+smask-stencil")
    doc = read(out)
    image = next(x for x in doc.objects.values() if isinstance(x, Stream) and b"Mask" in x.dict)
    stencil = stages.decode_image(doc, doc.resolve(image.dict[b"Mask"]))
    assert stencil.data[0].all() and not stencil.data[-1].any()  # ones hide
    soft = (np.indices((100, 100)).sum(0) % 256).astype(np.uint8)[..., None]
    assert "smask" not in stages.compress(write_image(make.photo(100, 100), b"DeviceRGB", soft), "standard")[1].images[0]["action"]


def test_masks_follow_their_image():
    soft = (np.indices((300, 300)).sum(0) % 256).astype(np.uint8)[..., None]
    for matte in (False, True):
        doc = make.with_image(make.photo(300, 300), content=b"q 0 0 36 72 re W n 72 0 0 72 0 0 cm /Im Do Q")
        mask = make.image(doc, soft, b"DeviceGray", **({"Matte": [0, 0, 0]} if matte else {}))
        next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image").dict[b"SMask"] = mask
        out, report, _ = stages.compress(write(doc, False), "standard")
        done = read(out)
        image = next(x for x in done.objects.values() if isinstance(x, Stream) and b"SMask" in x.dict)
        sizes = [(x.dict[b"Width"], x.dict[b"Height"]) for x in (image, done.resolve(image.dict[b"SMask"]))]
        assert sizes == ([(300, 300)] * 2 if matte else [(75, 150)] * 2), (matte, report.images)


def test_decode_arrays():
    doc = make.with_image(make.photo(20, 10, 1), space=b"DeviceGray", Decode=[1, 0])
    stream = next(x for x in doc.objects.values() if isinstance(x, Stream) and x.dict.get(b"Subtype") == b"Image")
    assert (stages.decode_image(doc, stream).data == 255 - make.photo(20, 10, 1)).all()
    assert Ref(1, 0) in doc.objects
