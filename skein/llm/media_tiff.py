"""TIFF images in binary columns: a reader that emits one row per page, and a writer of grey pages.

The reader walks the chain of image directories of both byte orders, takes strips or tiles, undoes no compression,
PackBits, LZW or deflate and the horizontal predictor, and returns the samples of each page (unsigned, of 1 to 32 bits, in
either bit order).  Nothing a file says is believed before it is checked: output is bounded by the page's size, that by
PAGE_BYTES and by what the stored bytes can hold, and every damage is a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

# Fixed values of the format: tags, sizes and codes of field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FILL_ORDER, SAMPLE_FORMAT = 322, 323, 324, 325, 266, 339
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# The most bytes that one stored byte can stand for.
_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
#: Pages of more bytes of samples are reported as errors; a row holds a whole page, and Arrow's binary values end at 2 GiB.
PAGE_BYTES = 1 << 30
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CODECS = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


def unpack_bits(data: bytes, size: int = PAGE_BYTES) -> bytes:
    """The first `size` bytes (up to 127 more), or fewer if the data end before."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, size = bytearray(), 0, len(data)
    while i < size:
        run = 1
        while run < 128 and i + run < size and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < size and j - i < 128 and not (j + 2 < size and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int = PAGE_BYTES) -> bytes:
    """The first `size` bytes or a few more.  Codes of 9 to 12 bits, high bits first; the width grows one code early, as the format asks."""
    clear, end = 256, 257
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, before = list(first), [], None
    bits = have = at = made = 0
    width = 9
    while made < size:
        while have < width:
            if at == len(data):
                return b"".join(out)
            bits, have, at = (bits << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == end:
            return b"".join(out)
        if code == clear:
            table, before, width = list(first), None, 9
            continue
        if code > (255 if before is None else min(len(table), 4095)):
            raise ValueError("a code beyond the table")
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
        out.append(entry)
        made += len(entry)
        before = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    width, table, prefix = 9, {bytes((i,)): i for i in range(256)}, b""
    codes = [(256, 9)]
    size = 258
    for byte in data:
        longer = prefix + bytes((byte,))
        if longer in table:
            prefix = longer
            continue
        codes.append((table[prefix], width))
        table[longer] = size
        size += 1
        prefix = longer[-1:]
        if size == 4094:
            codes.append((256, 12))
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        else:
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    if prefix:
        codes.append((table[prefix], width))
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    codes.append((257, width))
    for code, n in codes:
        bits, have = bits << n | code, have + n
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def _inflate(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind == PACKBITS:
        return unpack_bits(data, size)[:size]
    if kind == LZW:
        return lzw_decode(data, size)[:size]
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(f"broken deflate data: {e}") from e
    raise ValueError(f"compression {kind}")


def _deflate(kind: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode}[kind](data) if kind != DEFLATE else zlib.compress(data, 1)


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    photometric: int
    data: np.ndarray  # height x width x samples


Tags = dict[int, tuple[int, ...]]


def directories(blob: bytes) -> Iterator[tuple[str, Tags]]:
    """Byte order and tags of the image directories, in the order of their chain; ValueError where the chain breaks."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(blob[:4])
    if order is None or len(blob) < 8:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(f"{order}I", blob[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(blob):
            raise ValueError("a broken chain of directories")
        seen.add(at)
        (entries,) = struct.unpack_from(f"{order}H", blob, at)
        end = at + 2 + 12 * entries
        if end + 4 > len(blob):
            raise ValueError("a directory beyond the file")
        tags: Tags = {}
        for i in range(at + 2, end, 12):
            tag, kind, count = struct.unpack_from(f"{order}HHI", blob, i)
            if kind not in TYPES:
                continue
            size = TYPE_BYTES[kind] * count
            where = i + 8 if size <= 4 else struct.unpack_from(f"{order}I", blob, i + 8)[0]
            if where + size <= len(blob):  # values beyond the file are none
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", blob, where)
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", blob, end)


def read_pages(blob: bytes) -> Iterator[Page]:
    """The pages of a TIFF file in the order of its image directories; ValueError at the first damage."""
    for number, (order, tags) in enumerate(directories(blob)):
        yield _page(blob, order, tags, number)


def _page(blob: bytes, order: str, tags: Tags, number: int) -> Page:
    def one(tag: int, other: int | None = None) -> int:
        value = (tags.get(tag) or (other,))[0]
        if value is None:
            raise ValueError(f"a page without tag {tag}")
        return value

    width, height, samples, bits, kind, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(width, height, samples) < 1:
        raise ValueError("a page without samples")
    if bits not in (1, 2, 4, 8, 16, 32) or set(tags.get(BITS) or (bits,)) != {bits} or set(tags.get(SAMPLE_FORMAT) or (1,)) != {1}:
        raise ValueError("samples of another kind than unsigned ones of 1, 2, 4, 8, 16 or 32 bits")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError(f"predictor {predictor} for samples of {bits} bits")
    if kind not in _GROWTH:
        raise ValueError(f"compression {kind}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILES in tags
    starts, sizes = tags.get(TILES if tiled else STRIPS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    if min(wide, high) < 1:
        raise ValueError("strips or tiles without samples")
    across, down = -(-width // wide), -(-height // high)
    parts = across * down * planes
    if len(starts) < parts or len(sizes) < parts:
        raise ValueError("strips or tiles are missing")
    line = -(-wide * each * bits // 8)  # bytes of a row of a strip or tile
    kind_of = np.dtype(f"{order}u{max(1, bits // 8)}")
    if width * height * samples * kind_of.itemsize > PAGE_BYTES or line * high > PAGE_BYTES:
        raise ValueError("a page of more bytes than PAGE_BYTES")
    if min(starts[:parts]) < 0 or min(sizes[:parts]) < 0 or width * height * samples * bits // 8 > _GROWTH[kind] * sum(sizes[:parts]):
        raise ValueError("a page of more samples than its data can hold")
    data = np.zeros((height, width, samples), kind_of.newbyteorder("="))
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            start, size = starts[plane * across * down + k], sizes[plane * across * down + k]
            stored = blob[start : start + size]
            raw = _inflate(kind, stored.translate(_TURNED) if one(FILL_ORDER, 1) == 2 else stored, rows * line)
            if len(raw) < rows * line:
                raise ValueError("a strip or tile is too short")
            block = _samples(raw, kind_of, bits, rows, line)[:, : wide * each].reshape(rows, wide, each).astype(data.dtype)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=data.dtype)
            h, w = min(rows, height - y), min(wide, width - x)
            data[y : y + h, x : x + w, plane * each : (plane + 1) * each] = block[:h, :w]
    return Page(number, width, height, samples, bits, kind, predictor, tiled, one(PHOTOMETRIC, 1), data)


def _samples(raw: bytes, kind_of: np.dtype, bits: int, rows: int, line: int) -> np.ndarray:
    """rows x samples, those that fill up a row's last byte included."""
    if bits >= 8:
        return np.frombuffer(raw, kind_of, rows * line // kind_of.itemsize).reshape(rows, -1)
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    packed = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line, 1)
    return (packed >> shifts & np.uint8((1 << bits) - 1)).reshape(rows, -1)


def write_pages(pages: list[np.ndarray], codec: str = "deflate", predictor: bool = True, rows: int = 64, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF file of grey 8-bit pages (arrays of height x width), in strips of some rows or in square tiles."""
    kind = CODECS[codec]
    out = bytearray((b"II*\x00" if order == "<" else b"MM\x00*") + bytes(4))
    link = 4
    for page in pages:
        height, width = page.shape
        wide, high = (tile, tile) if tile else (width, rows)
        starts, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = page[y : y + high, x : x + wide]
                if tile and block.shape != (tile, tile):
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                packed = _deflate(kind, np.ascontiguousarray(block).tobytes())
                starts.append(len(out))
                sizes.append(len(packed))
                out += packed
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILES, 4, starts), (TILE_BYTES, 4, sizes)] if tile else [(ROWS, 4, [rows]), (STRIPS, 4, starts), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind_of, values in sorted(tags):
            value = struct.pack(f"{order}{len(values)}{TYPES[kind_of]}", *values)
            if len(value) > 4:
                out += bytes(len(out) % 2)
                value, place = struct.pack(f"{order}I", len(out)), value
                out += place
            entries += struct.pack(f"{order}HHI", tag, kind_of, len(values)) + value.ljust(4, b"\x00")
        out += bytes(len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def page_rows(blob: bytes) -> Iterator[tuple[int | None, Page | None, str | None]]:
    """(page number, page, error): a page that can't be read is an error with its number, a broken chain one without, at the end."""
    number = 0
    try:
        for number, (order, tags) in enumerate(directories(blob)):
            try:
                yield number, _page(blob, order, tags, number), None
            except ValueError as e:
                yield number, None, str(e)
    except ValueError as e:
        yield None, None, str(e)


def tiff_pages(media: DataFrame, id_col: str, blob_col: str, data: bool = True) -> DataFrame:
    """One row per page: id, page (from 0), width, height, samples, bits, compression, predictor, tiled, samples' bytes, error.

    Samples are rows of pixels, one byte each up to 8 bits, else little-endian.  A null or empty blob gives no rows.  A page
    that is damaged or of another kind gives a row with its number and the reason in error, and the next pages are read; a broken
    chain of directories gives a last row with page null.  Ids may repeat or be null.
    """
    names = ["id", "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "data", "error"]
    kinds = [pa.string(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, blob in zip(batch.column(0), batch.column(1), strict=True):
                for number, p, error in page_rows(stored) if (stored := blob.as_py()) else ():
                    if p is None:
                        rows.append((key.as_py(), number, *[None] * 8, error))
                        continue
                    raw = p.data.astype(p.data.dtype.newbyteorder("<")).tobytes() if data else None
                    rows.append((key.as_py(), p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, raw, None))
                    size += len(raw or b"")
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
            yield out(rows)

    kind = media.schema[id_col].dataType.simpleString()
    made = arrow_map(media.select(F.col(id_col).cast("string").alias("id"), F.col(blob_col).cast("binary").alias("blob")), run, "id string, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string")
    return made.withColumn("id", F.col("id").cast(kind))


# --- texts stored as pages -------------------------------------------------------------------------------------------

UNIT, SIDE, PAGE_ROWS = 576, 24, 4096


def text_payload(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and the bytes padded with 255 to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def store_payload(payload: bytes) -> bytes:
    """A TIFF file whose pages are SIDE samples wide and at most PAGE_ROWS high; deflate strips with predictor."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    return write_pages([lines[i : i + PAGE_ROWS] for i in range(0, len(lines), PAGE_ROWS)], rows=PAGE_ROWS)


def page_features(pages: list[Page]) -> str:
    """Number of pages, samples, mean, standard deviation, distinct values and mean step between neighbours in a line."""
    total = sum(p.data.size for p in pages)
    counts = sum(np.bincount(p.data.ravel(), minlength=256) for p in pages)
    values = np.arange(256)
    mean = float((counts * values).sum()) / total
    spread = (float((counts * values * values).sum()) / total - mean * mean) ** 0.5
    steps = sum(int(np.abs(np.diff(p.data[:, :, 0].astype(np.int16), axis=1)).sum()) for p in pages) / sum(p.height * (p.width - 1) for p in pages)
    return f"pages={len(pages)};samples={total};mean={mean:.6f};std={spread:.6f};values={int((counts > 0).sum())};step={steps:.6f}"


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Stores every whole text as TIFF pages, reads the pages back and describes what was read.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), with media=True
    also the stored file.  Null counts as the empty text (one unit of padding).  One row per input row, null ids and
    repeated rows included; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * media
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(text: str | None) -> tuple:
        size, payload = text_payload(text)
        stored = store_payload(payload)
        pages = list(read_pages(stored))
        back = b"".join(p.data.tobytes() for p in pages)
        return size, len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), sha256(stored).hexdigest(), page_features(pages), stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [row(x.as_py()) for x in part.column(1)]
                columns = [part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1 : len(names)]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
