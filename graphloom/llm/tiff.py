"""TIFF columns: a page reader for binary columns, and a lossless writer of bytes as grayscale pages.

The reader walks the chain of image directories, decodes uncompressed, PackBits, LZW or deflate
strips and tiles, undoes the horizontal predictor and emits one row per page. It reads either byte
order and 8-bit samples, chunky or planar. Defined results: null or empty bytes and files that
break the format give one row with page null and the reason in ``error``; directories that loop end
the walk with an error; pages decoded before a fault are kept. An empty table gives an empty result.
Other columns are untouched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


# Fixed values of the TIFF 6.0 format: tags, compression schemes, field types and their sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}
SCHEMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MAX = 256, 257, 258, 4094

#: The writer's page: 64 samples a row, at most this many rows a page, and rows a strip; tiles are 64 x 64.
PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS, TILE_ROWS = 64, 1024, 256, 64
#: A page of more samples than this is refused, as its header alone could exhaust memory.
MOST_SAMPLES = 1 << 28


class TiffError(ValueError):
    """The bytes break the format, or use a part of it that is not read."""


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples_per_pixel: int
    compression: str
    predictor: int
    tiled: bool
    samples: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become runs, the rest literals of at most 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    sizes = np.diff(edges)
    out, done = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(done, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3):
        at, left = int(edges[k]), int(sizes[k])
        literal(at)
        while left > 1:
            n = min(left, 128)
            out += bytes((257 - n, data[at]))
            left -= n
        done = int(edges[k + 1]) - left
    literal(len(data))
    return bytes(out)


def packbits_rows(image: np.ndarray) -> bytes:
    """Each row on its own, as the format asks; rows of at most 128 samples without a run of three are one literal."""
    same = image[:, 1:] == image[:, :-1]
    runs = (same[:, 1:] & same[:, :-1]).any(axis=1)
    if image.shape[1] > 128:
        runs[:] = True
    head = bytes((image.shape[1] - 1 & 127,))
    flat = [packbits_encode(bytes(1) * image.shape[1])] if runs.any() else [b""]
    return b"".join(head + r.tobytes() if not run else flat[0] if not r.any() else packbits_encode(r.tobytes()) for r, run in zip(image, runs, strict=True))


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, end = bytearray(), 0, len(data)
    while len(out) < size:
        if i >= end:
            raise TiffError("PackBits data end early")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of the given widths, most significant bit first."""
    values, sizes = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(sizes)
    bits = np.zeros((int(ends[-1]) + 7) // 8 * 8, np.uint8)
    for k in range(12):
        some = sizes > k
        bits[ends[some] - 1 - k] = (values[some] >> k) & 1
    return np.packbits(bits).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """The format's LZW: 9 to 12 bits, widths that grow one code early, a clear code at the start and when full."""
    codes, widths = [LZW_CLEAR], [9]
    table: dict[int, int] = {}
    free, width, have = LZW_FIRST, 9, -1
    for byte in data:
        if have < 0:
            have = byte
            continue
        key = have << 8 | byte
        longer = table.get(key)
        if longer is not None:
            have = longer
            continue
        codes.append(have)
        widths.append(width)
        table[key] = free
        free += 1
        have = byte
        if free == LZW_MAX:
            codes.append(LZW_CLEAR)
            widths.append(12)
            table, free, width = {}, LZW_FIRST, 9
        elif free == 1 << width:
            width += 1
    if have >= 0:
        codes.append(have)
        widths.append(width)
        free += 1
        if free == LZW_MAX:
            codes.append(LZW_CLEAR)
            widths.append(12)
            width = 9
        elif free == 1 << width:
            width += 1
    codes.append(LZW_END)
    widths.append(width)
    return _pack_codes(codes, widths)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, made = [], 0
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(singles), 9, b""
    acc = bits = i = 0
    end = len(data)
    while made < size:
        while bits < width:
            if i >= end:
                raise TiffError("LZW data end early")
            acc = (acc & 0xFFFF) << 8 | data[i]
            i += 1
            bits += 8
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == LZW_CLEAR:
            table, width, last = list(singles), 9, b""
            continue
        if code == LZW_END:
            break
        n = len(table)
        if not last:
            if code > 255:
                raise TiffError("LZW data begin with an unknown code")
            entry = singles[code]
        else:
            if code < n:
                entry = table[code]
            elif code == n:
                entry = last + last[:1]
            else:
                raise TiffError("LZW data hold an unknown code")
            table.append(last + entry[:1])
            if n + 2 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        made += len(entry)
        last = entry
    got = b"".join(out)
    if len(got) < size:
        raise TiffError("LZW data end early")
    return got[:size]


def _inflate(data: bytes, size: int) -> bytes:
    try:
        got = zlib.decompressobj().decompress(data, size) if size else b""
    except zlib.error as e:
        raise TiffError(f"deflate data are broken: {e}") from e
    if len(got) < size:
        raise TiffError("deflate data end early")
    return got


def _expand(data: bytes, scheme: int, rows: int, row_bytes: int) -> bytes:
    size = rows * row_bytes
    if scheme == NONE:
        if len(data) < size:
            raise TiffError("raw data end early")
        return data[:size]
    if scheme == PACKBITS:
        return packbits_decode(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, DEFLATE_OLD):
        return _inflate(data, size)
    raise TiffError(f"compression {scheme} is not read")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """Tags of one image directory, and the place of the next."""
    try:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            if kind not in FIELDS or kind == 2:
                continue
            code, size = FIELDS[kind]
            place = at + 2 + 12 * k + 8
            if count * size > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            if place + count * size > len(data):
                raise TiffError("a field lies beyond the end")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        (follow,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError("a directory lies beyond the end") from e
    return tags, follow


def _page(data: bytes, tags: dict[int, list[int]], number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tags.get(tag):
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, per = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    scheme, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if any(b != 8 for b in tags.get(BITS, [1])):
        raise TiffError("only 8-bit samples are read")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} is not read")
    if width * height * per > MOST_SAMPLES:
        raise TiffError("the page is too large")
    planes, chunk = (per, 1) if planar == 2 else (1, per)
    tiled = TILE_OFFSETS in tags
    if tiled:
        part_w, part_h = one(TILE_WIDTH), one(TILE_HEIGHT)
        places, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        part_w, part_h = width, min(one(ROWS_PER_STRIP, height), height)
        places, counts = tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
    if not part_w or not part_h or part_w * part_h * per > MOST_SAMPLES:
        raise TiffError("the parts of a page have no fit size")
    across, down = -(-width // part_w), -(-height // part_h)
    if len(places) < planes * across * down or len(counts) < planes * across * down:
        raise TiffError("parts of a page are missing")
    image = np.zeros((planes, height, width * chunk), np.uint8)
    for k in range(planes * across * down):
        plane, y, x = k // (across * down), k // across % down * part_h, k % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        raw = _expand(data[places[k] : places[k] + counts[k]], scheme, rows, part_w * chunk)
        part = np.frombuffer(raw, np.uint8).reshape(rows, part_w, chunk)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        tall, wide = min(rows, height - y), min(part_w, width - x)
        image[plane, y : y + tall, x * chunk : (x + wide) * chunk] = part[:tall, :wide].reshape(tall, wide * chunk)
    if planes > 1:
        image = image.transpose(1, 2, 0)
    return Page(number, width, height, per, SCHEMES[scheme], predictor, tiled, image.tobytes())


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        tags, follow = _directory(data, at, order)
        yield _page(data, tags, len(seen))
        seen.add(at)
        at = follow


def write_pages(payload: bytes, scheme: int, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """Bytes, a multiple of 64 of them, as grayscale pages of 64 samples a row."""
    pack = {NONE: lambda b: b, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6)}.get(scheme)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for first in range(0, max(1, len(payload)), PAGE_WIDTH * PAGE_ROWS):
        samples = np.frombuffer(payload[first : first + PAGE_WIDTH * PAGE_ROWS], np.uint8).reshape(-1, PAGE_WIDTH)
        rows_a_part = TILE_ROWS if tiled else STRIP_ROWS
        places, counts = [], []
        for y in range(0, len(samples), rows_a_part):
            part = samples[y : y + rows_a_part]
            if tiled and len(part) < rows_a_part:
                part = np.pad(part, ((0, rows_a_part - len(part)), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            done = packbits_rows(part) if scheme == PACKBITS else pack(part.tobytes())
            places.append(len(out))
            counts.append(len(done))
            out += done
            out += b"\0" * (len(out) % 2)
        fields = {WIDTH: [PAGE_WIDTH], HEIGHT: [len(samples)], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [PAGE_WIDTH], TILE_HEIGHT: [TILE_ROWS], TILE_OFFSETS: places, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_COUNTS: counts}
        lists = {}
        for tag, values in fields.items():
            if len(values) > 1:
                lists[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields))
        for tag in sorted(fields):
            out += struct.pack(f"{order}HHII", tag, 4, len(fields[tag]), lists.get(tag, fields[tag][0]))
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


#: How the writer's variants are dealt to payloads: by the checksum of their bytes.
VARIANTS = ((NONE, 1, False), (PACKBITS, 1, False), (LZW, 1, False), (LZW, 2, True), (DEFLATE, 2, False), (DEFLATE, 1, True), (PACKBITS, 1, True), (NONE, 1, True))


def store_text(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a TIFF file."""
    payload = (text or "").encode("utf-8", "surrogatepass")
    payload += b"\0" * (-len(payload) % 64 or (0 if payload else 64))
    scheme, predictor, tiled = VARIANTS[zlib.crc32(payload) % len(VARIANTS)]
    return write_pages(payload, scheme, predictor, tiled)


def store_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text as a TIFF file. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([store_text(t) for t in texts], pa.binary())],
                    names=[key, "n_bytes", "media"],
                )

    kind = docs.schema[key].dataType
    return docs.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


PAGE_FIELDS = [
    ("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples_per_pixel", T.IntegerType()),
    ("compression", T.StringType()), ("predictor", T.IntegerType()), ("tiled", T.BooleanType()), ("samples", T.BinaryType()), ("error", T.StringType()),
]


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file in column media, in the files' order, beside the columns keep.

    A file's pages follow one another within a partition. A column of keep whose name is also one of
    the page's columns is refused with a ValueError.
    """
    clash = {f for f, _ in PAGE_FIELDS} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(f, t) for f, t in PAGE_FIELDS])
    n, names = len(keep), [f for f, _ in PAGE_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, pages = [], []
                for row, data in enumerate(part.column(n).to_pylist()):
                    try:
                        if not data:
                            raise TiffError("no bytes")
                        for p in read_pages(data):
                            rows.append(row)
                            pages.append((p.page, p.width, p.height, p.samples_per_pixel, p.compression, p.predictor, p.tiled, p.samples, None))
                    except TiffError as e:
                        rows.append(row)
                        pages.append((None,) * 8 + (str(e),))
                kept = [part.column(i).take(pa.array(rows, pa.int32())) for i in range(n)]
                made = [pa.array([p[i] for p in pages], arrow.field(n + i).type) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *names])

    return df.select(*keep, media).mapInArrow(run, schema)
