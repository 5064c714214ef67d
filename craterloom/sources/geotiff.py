"""GeoTIFF files in plain numpy: strips and tiles, LZW, deflate and PackBits, predictors, georeference, caps.

What a Spark task reads is one file's bytes; the caps are checked on its directory, before anything is unpacked.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The caps, the frame taken where a file names none, and the no-data value that is written.
MAX_DIMENSION, MAX_BYTES = 100_000, 4 * 1024**3
DEFAULT_CRS, NODATA = "IAU2000:30100", -9999.0

_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}


@dataclass
class GeoTiff:
    image: np.ndarray
    gsd_m: float
    origin: tuple[float, float] | None
    crs: str
    nodata: float | None
    sun_azimuth: float | None
    sun_elevation: float | None


def _directory(content: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", content, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", content, entry)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        where = entry + 8 if n * size <= 4 else struct.unpack_from(order + "I", content, entry + 8)[0]
        if kind == 2:
            tags[tag] = (content[where:where + n].split(b"\0")[0].decode("latin-1"),)
        else:
            tags[tag] = struct.unpack_from(f"{order}{n * len(code)}{code[0]}", content, where)
    return order, tags


def _lzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, widened one code early."""
    table: list[bytes] = []
    out, bits, held, width, before = [], 0, 0, 9, b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        piece = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + piece[:1])
        out.append(piece)
        before = piece
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _to_lzw(raw: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    def width(size: int) -> int:
        return 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12

    table: dict[bytes, int] = {}
    size, word = 258, b""
    put(256, 9)
    for i in range(len(raw)):
        longer = word + raw[i:i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0], width(size))
        table[longer] = size
        size += 1
        word = raw[i:i + 1]
        if size == 4095:  # full: begin anew
            put(256, 12)
            table, size = {}, 258
    if word:
        put(table[word] if len(word) > 1 else word[0], width(size))
    # the reader's table has one more entry by now
    put(257, width(size + 1))
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1:i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1:i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def read_geotiff(content: bytes, gsd_fallback: float = 1.0) -> GeoTiff:
    """The first band of a file's first image, with what its tags say; a ValueError says why a file is not read."""
    order, tags = _directory(content)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(256), one(257), one(277, 1)
    bits, form, packing, predictor, planar = one(258, 8), one(339, 1), one(259, 1), one(317, 1), one(284, 1)
    if max(width, height) > MAX_DIMENSION:
        raise ValueError(f"DIMENSIONS_TOO_LARGE: {width} x {height}")
    if width * height * samples * (bits // 8) > MAX_BYTES:
        raise ValueError(f"TOO_MANY_BYTES: {width * height * samples * (bits // 8)}")
    if packing not in _UNPACK:
        raise ValueError(f"UNKNOWN_COMPRESSION: {packing}")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    if 322 in tags:
        bh, bw, places, sizes = one(323), one(322), tags[324], tags[325]
    else:
        bh, bw, places, sizes = min(one(278, height), height), width, tags[273], tags[279]
    image = np.zeros((height, width), kind)
    deep = samples if planar == 1 else 1
    across = -(-width // bw)
    for k in range(across * -(-height // bh)):
        y, x = k // across * bh, k % across * bw
        rows = bh if 322 in tags else min(bh, height - y)
        raw = _UNPACK[packing](content[places[k]:places[k] + sizes[k]])
        need = rows * bw * deep * kind.itemsize
        if len(raw) < need:
            raise ValueError("TRUNCATED")
        if predictor == 3:  # bytes of a row's numbers by significance, differenced
            part = np.cumsum(np.frombuffer(raw, np.uint8, need).reshape(rows, -1).reshape(rows, -1, deep), 1, dtype=np.uint8).reshape(rows, -1)
            block = np.ascontiguousarray(part.reshape(rows, kind.itemsize, bw * deep).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0].reshape(rows, bw, deep)
        else:
            block = np.frombuffer(raw, kind, rows * bw * deep).reshape(rows, bw, deep)
            if predictor == 2:
                block = np.cumsum(block, 1, dtype=kind.newbyteorder("=")).astype(kind)
        h, w = min(rows, height - y), min(bw, width - x)
        image[y:y + h, x:x + w] = block[:h, :w, 0]
    scale, tie = tags.get(33550), tags.get(33922)
    if scale is None and 34264 in tags:
        m = tags[34264]
        scale, tie = (abs(m[0]), abs(m[5])), (0, 0, 0, m[3], m[7])
    gsd = (abs(scale[0]) + abs(scale[1])) / 2 if scale and scale[0] and scale[1] else gsd_fallback
    items = {}
    if 42112 in tags and "<!" not in tags[42112][0]:  # no document types, no entities
        try:
            items = {e.get("name"): (e.text or "").strip() for e in ElementTree.fromstring(tags[42112][0]).iter("Item")}
        except ElementTree.ParseError:
            items = {}

    def number(text):
        try:
            return float(text)
        except (TypeError, ValueError):
            return None

    sun = [number(items.get(k)) for k in ("SUN_AZIMUTH", "SUN_ELEVATION")]
    sun = sun if None not in sun else [None, None]
    crs = tags[34737][0].split("|")[0].strip() if 34737 in tags else ""
    return GeoTiff(image.astype(np.float32), float(gsd), (float(tie[3]), float(tie[4])) if tie else None, crs or DEFAULT_CRS, number(one(42113)), *sun)


def write_geotiff(image: np.ndarray, gsd_m: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), crs: str = DEFAULT_CRS, nodata: float = NODATA,
                  sun: tuple[float, float] | None = None, compress: str = "lzw", rows: int = 64) -> bytes:
    """A float32 file of strips of ``rows`` rows (compress: lzw, deflate or none); NaN becomes the no-data value."""
    h, w = image.shape
    data = np.where(np.isnan(image), nodata, image).astype("<f4")
    code, pack = {"lzw": (5, _to_lzw), "deflate": (8, zlib.compress), "none": (1, bytes)}[compress]
    strips = [pack(data[y:y + rows].tobytes()) for y in range(0, h, rows)]
    places = np.cumsum([8, *(len(s) + len(s) % 2 for s in strips)])
    text = lambda s: (2, s.encode("latin-1") + b"\0")
    numbers = lambda kind, fmt, *v: (kind, struct.pack(f"<{len(v)}{fmt}", *v))
    tags = {
        256: numbers(4, "I", w), 257: numbers(4, "I", h), 258: numbers(3, "H", 32), 259: numbers(3, "H", code), 262: numbers(3, "H", 1), 273: numbers(4, "I", *places[:-1].tolist()),
        277: numbers(3, "H", 1), 278: numbers(4, "I", min(rows, h)), 279: numbers(4, "I", *map(len, strips)), 339: numbers(3, "H", 3),
        33550: numbers(12, "d", gsd_m, gsd_m, 0.0), 33922: numbers(12, "d", 0.0, 0.0, 0.0, *origin, 0.0), 34737: text(crs + "|"), 42113: text(repr(float(nodata))),
    }
    if sun:
        tags[42112] = text(f'<GDALMetadata><Item name="SUN_AZIMUTH">{sun[0]!r}</Item><Item name="SUN_ELEVATION">{sun[1]!r}</Item></GDALMetadata>')
    at = int(places[-1])
    beyond, extra = at + 2 + 12 * len(tags) + 4, b""
    head = struct.pack("<H", len(tags))
    for tag, (kind, raw) in sorted(tags.items()):
        n = len(raw) // _SIZES[kind][1]
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, n, beyond + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + b"".join(s + b"\0" * (len(s) % 2) for s in strips) + head + struct.pack("<I", 0) + extra


def verified(content: bytes, image: np.ndarray, nodata: float = NODATA) -> bytes:
    """content, if reading it again gives the image; an error otherwise."""
    if not np.array_equal(read_geotiff(content).image, np.where(np.isnan(image), nodata, image).astype(np.float32)):
        raise ValueError("OUTPUT_VERIFICATION_FAILED")
    return content


def read_headers(files: DataFrame, gsd_fallback: float = 1.0) -> DataFrame:
    """path, width, height, gsd_m, origin_x, origin_y, crs, nodata, sun_azimuth, sun_elevation, problem of files (path, content)."""
    names = ["path", "width", "height", "gsd_m", "origin_x", "origin_y", "crs", "nodata", "sun_azimuth", "sun_elevation", "problem"]

    def run(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    t = read_geotiff(content, gsd_fallback)
                    rows.append((path, t.image.shape[1], t.image.shape[0], t.gsd_m, *(t.origin or (None, None)), t.crs, t.nodata, t.sun_azimuth, t.sun_elevation, None))
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    rows.append((path, *[None] * 9, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, gsd_m double, origin_x double, origin_y double, crs string, nodata double, sun_azimuth double, sun_elevation double, problem string")


def read_pixels(files: DataFrame) -> DataFrame:
    """path, y, x, value of files (path, content), 256 rows of an image at a time; the file's no-data value is null."""
    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                t = read_geotiff(content)
                for y in range(0, t.image.shape[0], 256):
                    part = t.image[y:y + 256].astype(np.float64)
                    rows, columns = np.indices(part.shape)
                    value = part.ravel() if t.nodata is None else np.where(part.ravel() == np.float32(t.nodata), np.nan, part.ravel())
                    yield pd.DataFrame({"path": path, "y": rows.ravel() + y, "x": columns.ravel(), "value": value})

    px = files.select("path", "content").mapInPandas(run, "path string, y int, x int, value double")
    return px.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def min_max(pixels: DataFrame, key: str = "path") -> DataFrame:
    """Images scaled between their smallest and largest value; flat ones are 0."""
    span = pixels.groupBy(key).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    return pixels.join(span, key).withColumn("value", F.when(F.col("high") > F.col("low"), scaled).when(F.col("value").isNotNull(), 0.0)).drop("low", "high")
