"""TIFF files of other origin than the writer's, and damaged ones."""

import random
import struct

import numpy as np
import pytest

from skein.llm import media_tiff


def file_of(pages, order="<"):
    """A file built tag by tag: pages are (tags, stored parts); the parts' places are filled in for tag 273 or 324."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for tags, parts in pages:
        starts = []
        for part in parts:
            starts.append(len(out))
            out += part + bytes(len(part) % 2)
        tags = dict(tags)
        tiled = 322 in tags
        tags[324 if tiled else 273], tags[325 if tiled else 279] = starts, [len(p) for p in parts]
        entries = b""
        for tag, values in sorted(tags.items()):
            value = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                place = len(out)
                out += value
                value = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + value
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def grey(width, height, kind, **more):
    return {256: [width], 257: [height], 258: [8], 259: [kind], 262: [1], 278: [height], **{int(k[1:]): v for k, v in more.items()}}


PACKED = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the format's published example
UNPACKED = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
LZW_TEXT, LZW_CODES = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]  # likewise


def packed_codes(codes, width=9):
    number = "".join(f"{c:0{width}b}" for c in codes)
    return bytes(int(number[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(number), 8))


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_of_other_origin(order):
    tile = bytes(range(16))
    pages = [
        (grey(12, 2, 32773), [PACKED]),
        (grey(9, 1, 5), [packed_codes(LZW_CODES)]),
        (grey(5, 3, 1, t322=[4], t323=[4]), [tile, tile[::-1]]),
        ({**grey(10, 2, 1), 258: [1]}, [bytes.fromhex("AA40FF80")]),
        ({**grey(10, 2, 1, t266=[2]), 258: [1]}, [bytes.fromhex("5502FF01")]),
        ({**grey(3, 1, 1), 258: [4]}, [bytes.fromhex("1230")]),
    ]
    found = list(media_tiff.read_pages(file_of(pages, order)))
    assert found[0].data.tobytes() == UNPACKED and found[1].data.tobytes() == LZW_TEXT
    assert found[2].data[:, :, 0].tolist() == [[0, 1, 2, 3, 15], [4, 5, 6, 7, 11], [8, 9, 10, 11, 7]]
    assert found[3].data[:, :, 0].tolist() == found[4].data[:, :, 0].tolist() == [[1, 0] * 4 + [0, 1], [1] * 9 + [0]]
    assert found[5].data[:, :, 0].tolist() == [[1, 2, 3]]


def test_damage_is_reported_and_the_next_pages_are_read(spark):
    whole = (grey(2, 2, 1), [b"abcd"])
    bad = [
        (grey(9, 1, 5), [packed_codes([256, 300, 257])]),
        (grey(0, 2, 1), [b""]),
        (grey(16_777_215, 16_777_215, 8), [b"x"]),
        (grey(4, 4, 1, t322=[0], t323=[4]), [b"x" * 16]),
        (grey(2, 2, 8), [b"no deflate"]),
        (grey(2, 2, 7), [b"jpeg"]),
        ({**grey(2, 2, 1), 277: [0]}, [b"abcd"]),
    ]
    blob = file_of([whole, *bad, whole])
    rows = media_tiff.tiff_pages(spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(b"GIF89a..")), (None, None)], "id long, blob binary"), "id", "blob").collect()
    assert [(r.id, r.page, r.error is None) for r in rows] == [(1, 0, True), *[(1, i, False) for i in range(1, 8)], (1, 8, True), (2, None, False)]
    assert bytes(rows[8].data) == b"abcd"


def test_no_damage_raises():
    rng = random.Random(9)
    page = np.random.default_rng(1).integers(0, 256, (40, 24), np.uint8)
    files = [media_tiff.write_pages([page, page[:7]], codec, order=order, tile=tile) for codec in media_tiff.CODECS for order in "<>" for tile in (0, 16)]
    for n in range(1500):
        blob = bytearray(rng.choice(files))
        for _ in range(rng.randint(1, 6)):
            blob[rng.choice((rng.randrange(len(blob)), rng.randrange(max(0, len(blob) - 200), len(blob))))] = rng.choice((0, 255, rng.randrange(256)))
        if n % 5 == 0:
            blob = blob[: rng.randrange(len(blob))]
        for _, p, error in media_tiff.page_rows(bytes(blob)):
            assert (p is None) != (error is None)
