"""Media columns: Netpbm and BMP images decoded to arrays, area-resized, written as NPY tiles with difference hashes.

`decode` reads PBM, PGM, PPM (plain and raw, 1 to 16 bits) and uncompressed BMP of 1, 4, 8, 16, 24
or 32 bits, with masks too; `scaled` stretches samples of another maximum to 8 or 16 bits, as `image_tiles` does. `area_resize` takes exact box means from an integral image in whole numbers, so
that results are the same on any machine; the integral image is built in bands of rows and
kept only at the box edges, which bounds memory. `tiles` cuts an array into NPY files of a
fixed side. `difference_hash` compares neighbours of a 9 x 8 reduction.

Very long texts and large images are one row's work: their bytes, and bands of rows, are in memory at once.
A null or empty image decodes to null columns and a broken one to null columns with `error`
set; no row is dropped. Repeated rows stay; an empty table gives an empty one; only the named
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import released, unused

WIDTH = 64
TILE = 32
BAND_ROWS = 4096


class BadImage(ValueError):
    pass


def decode(raw: bytes, scaled: bool = False) -> np.ndarray:
    """H x W (gray) or H x W x 3 (RGB), uint8 or uint16."""
    if raw[:2] == b"BM":
        return _bmp(raw)
    if len(raw) > 2 and raw[:1] == b"P" and raw[1:2] in b"123456":
        image, top = _netpbm(raw)
        full = 255 if top < 256 else 65535
        return image if not scaled or top == full else ((np.minimum(image, top).astype(np.int64) * full + top // 2) // top).astype(image.dtype)
    raise BadImage("neither Netpbm nor BMP")


def _netpbm(raw: bytes) -> tuple[np.ndarray, int]:
    """The samples as they are, and their maximum; bits are 0 and 255."""
    kind, at, numbers = raw[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at : at + 1] == b"#"):
            if raw[at : at + 1] == b"#":
                end = raw.find(b"\n", at)
                at = len(raw) if end < 0 else end
            at += 1
        start = at
        while at < len(raw) and raw[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise BadImage("header ends early")
        numbers.append(int(raw[start:at]))
    width, height, top = *numbers[:2], numbers[2] if len(numbers) > 2 else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise BadImage("impossible size or maximum")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    plain = re.sub(rb"#[^\r\n]*", b" ", raw[at:]) if kind < 4 else b""
    if kind == 1:
        bits = [b - 48 for b in plain if b in b"01"]
        top = 255
        if len(bits) < n:
            raise BadImage("too few samples")
        flat = (1 - np.array(bits[:n], np.uint8)) * np.uint8(255)
    elif kind in (2, 3):
        words = plain.split()
        if len(words) < n:
            raise BadImage("too few samples")
        flat = np.array(words[:n]).astype(np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        row = (width + 7) // 8
        data = np.frombuffer(raw, np.uint8, offset=at + 1)
        if len(data) < row * height:
            raise BadImage("too few samples")
        return (1 - np.unpackbits(data[: row * height].reshape(height, row), axis=1)[:, :width]) * np.uint8(255), 255
    else:
        data = np.frombuffer(raw, np.dtype(">u2") if top > 255 else np.uint8, offset=at + 1, count=-1 if (len(raw) - at - 1) % (2 if top > 255 else 1) == 0 else (len(raw) - at - 1) // 2)
        if len(data) < n:
            raise BadImage("too few samples")
        flat = data[:n].astype(np.uint16) if top > 255 else data[:n]
    return flat.reshape(height, width, 3) if depth == 3 else flat.reshape(height, width), top


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise BadImage("header ends early")
    offset, header, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", raw, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or width < 1 or height == 0 or packed == 3 and bits not in (16, 32):
        raise BadImage("unsupported BMP")
    rows, row = abs(height), (width * bits + 31) // 32 * 4
    if len(raw) < offset + rows * row:
        raise BadImage("too few samples")
    data = np.frombuffer(raw, np.uint8, rows * row, offset).reshape(rows, row)
    data = data[::-1] if height > 0 else data
    if bits == 16 or packed == 3:
        # fixed values: five bits a colour where there are no masks
        masks = struct.unpack_from("<III", raw, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        if not all(masks):
            raise BadImage("a colour without bits")
        pixels = np.ascontiguousarray(data[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        channels = [(pixels & m) // (m & -m) for m in masks]
        tops = [m // (m & -m) for m in masks]
        return np.stack([((c * 255 + t // 2) // t).astype(np.uint8) for c, t in zip(channels, tops)], axis=2)
    if bits >= 24:
        return data[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    index = data if bits == 8 else np.unpackbits(data, axis=1) if bits == 1 else np.stack([data >> 4, data & 15], axis=2).reshape(rows, -1)
    used = struct.unpack_from("<I", raw, 46)[0] or 1 << bits
    if 14 + header + 4 * used > len(raw):
        raise BadImage("palette ends early")
    palette = np.zeros((1 << bits, 3), np.uint8)
    table = np.frombuffer(raw, np.uint8, 4 * min(used, 1 << bits), 14 + header).reshape(-1, 4)
    palette[: len(table)] = table[:, 2::-1]
    out = palette[index[:, :width]]
    return out[:, :, 0] if (palette[:, :1] == palette).all() else out


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A raw PGM whose samples are the payload's bytes, `width` a row."""
    if not payload or len(payload) % width:
        raise BadImage("the payload must fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means, rounded half up: uint8 or uint16, the last axis kept for colours."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], axis=2)
    h, w = image.shape
    edges = [divmod(i * h, height) for i in range(height + 1)]
    wanted = sorted({q + d for q, _ in edges for d in (0, 1) if q + d <= h})
    columns = np.array([divmod(j * w, width) for j in range(width + 1)], np.int64)
    at, part = columns[:, 0], columns[:, 1]
    beyond = np.minimum(at + 1, w)

    def across(line: np.ndarray) -> np.ndarray:
        """The integral image's row at the box edges, times `width`."""
        return line[at] * (width - part) + line[beyond] * part

    kept = {0: np.zeros(width + 1, np.int64)}
    carry, todo = np.zeros(w + 1, np.int64), [x for x in wanted if x]
    for start in range(0, h, BAND_ROWS):
        band = image[start : start + BAND_ROWS].astype(np.int64)
        total = np.cumsum(band, axis=0)
        for x in [x for x in todo if start < x <= start + len(band)]:
            kept[x] = across(carry + np.concatenate([[0], np.cumsum(total[x - start - 1])]))
        carry = carry + np.concatenate([[0], np.cumsum(total[-1])])
    lines = np.stack([kept[q] * (height - r) + kept[min(q + 1, h)] * r for q, r in edges])
    boxes = lines[1:, 1:] - lines[:-1, 1:] - lines[1:, :-1] + lines[:-1, :-1]
    return ((2 * boxes + h * w) // (2 * h * w)).astype(image.dtype)


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(gray(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int = TILE) -> list[bytes]:
    """NPY files of `side` x `side`, row by row; the last ones are filled with zeros."""
    h, w = image.shape[:2]
    whole = np.zeros((-(-h // side) * side, -(-w // side) * side, *image.shape[2:]), image.dtype)
    whole[:h, :w] = image
    return [npy(whole[y : y + side, x : x + side]) for y in range(0, len(whole), side) for x in range(0, whole.shape[1], side)]


def features(image: np.ndarray, side: int = TILE, target: int = WIDTH) -> tuple[list[bytes], str]:
    """The tiles of the image at `target` x `target`, and its difference hash."""
    return tiles(area_resize(image, target, target), side), difference_hash(image)


def image_tiles(df: DataFrame, image: str = "image", key: str = "image_id", side: int = TILE, target: int = WIDTH) -> DataFrame:
    """Per row of a table of image files: key, height, width, channels, tiles (NPY files), dhash, error."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = []
                for raw in part.column(1).to_pylist():
                    try:
                        a = decode(raw, scaled=True) if raw else None
                        t, d = features(a, side, target) if a is not None else (None, None)
                        rows.append((*(a.shape[:2] if a is not None else (None, None)), None if a is None else 1 if a.ndim == 2 else a.shape[2], t, d, None))
                    except (BadImage, struct.error, ValueError, OverflowError) as e:
                        rows.append((None, None, None, None, None, str(e)[:200]))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[key, "height", "width", "channels", "tiles", "dhash", "error"])

    return df.select(key, F.col(image).cast("binary").alias(unused("image", [key]))).mapInArrow(released(run), f"`{key}` {kind}, height int, width int, channels int, tiles array<binary>, dhash string, error string")


def text_media(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, with_tiles: bool = False) -> DataFrame:
    """Stores every text losslessly as a PGM, reads the file back and computes its features.

    The payload is the text's UTF-8 bytes (none for null) and zeros up to a positive multiple of
    `width`. Digests and features come from the decoded samples. feature: the difference hash, a
    colon, and the start of the tiles' SHA-256; with_tiles adds the PGM and the NPY files.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_tiles bigint" + ", media binary, tiles array<binary>" * with_tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for t in part.column(1):
                    data = (t.as_py() or "").encode()
                    media = encode_pgm(data + bytes(-len(data) % width if data else width), width)
                    samples = decode(media)
                    back = samples.tobytes()
                    cut, dhash = features(samples)
                    digest = hashlib.sha256(b"".join(cut)).hexdigest()[:16]
                    rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{dhash}:{digest}", len(cut), media, cut))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary(), pa.list_(pa.binary())] if with_tiles else [])]
                names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_tiles", "media", "tiles"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names[: len(kinds) + 1])

    return df.select(key, F.col(text).cast("string").alias(unused("text", [key]))).mapInArrow(released(run), schema)
