"""Media columns: PNG files in binary columns, written and read without an image library.

`store_media` lays bytes out as an 8-bit greyscale picture and writes a PNG: signature, IHDR, IDAT (zlib), IEND, each chunk
with its checksum; each row gets the filter (none, left or upper neighbour) that leaves the least sum of differences.
`read_media` tests every checksum, inflates, undoes the row filters (all five of the format) with numpy and computes a hash of
the low frequencies of the cosine transform.  Both are narrow: no shuffle, a worker holds a slice of rows at a time.

Cases: null text is empty; an empty payload is one tile of padding; a null, damaged or malformed file, or one whose samples
exceed `LIMIT` bytes, gives null results and the reason in `error`; equal texts give equal files and hashes; an empty table
gives no rows.  Only the named columns are read; ids may repeat or be null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Bytes a line, and what a payload is filled up to a multiple of: a tile of 24 x 24.
WIDTH, TILE = 24, 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by PNG colour type, at 8 bits.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Most bytes of samples that are inflated; a small file can claim and hold far more.
LIMIT = 1 << 30
SIDE, LOW = 32, 8
_STEP = np.pi / (2 * SIDE)
_COSINES = np.cos(np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) * _STEP)


def pad(data: bytes, tile: int = TILE) -> bytes:
    """Bytes 255 up to a positive multiple of the tile."""
    return data + b"\xff" * (tile if not data else -len(data) % tile)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_rows(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """The filtered rows of a picture; rows: height x bytes a row."""
    x = rows.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:], up[1:] = x[:, :-bpp], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, bpp:] = x[:-1, :-bpp]
    guess = np.select([kinds[:, None] == k for k in range(5)], [np.zeros_like(x), left, up, (left + up) // 2, _paeth(left, up, corner)])
    return ((x - guess) & 255).astype(np.uint8)


def _paeth(a, b, c):
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))


def best_kinds(rows: np.ndarray, bpp: int) -> np.ndarray:
    """For each row the filter of the first three (none, left, up) with the least sum of absolute differences."""
    left, up = rows.copy(), rows.copy()
    left[:, bpp:] -= rows[:, :-bpp]
    up[1:] -= rows[:-1]
    return np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, left, up)], axis=0).astype(np.uint8)


def unfilter_rows(rows: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """The picture behind the filtered rows.  Rows of the first three kinds go all at once, between runs of the two kinds that
    look at left and upper neighbours at once; those go by diagonals."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"unknown row filter {kinds.max()}")
    out, slow = rows.copy(), kinds > 2
    cuts = np.flatnonzero(np.r_[True, slow[1:] != slow[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        above = out[a - 1] if a else np.zeros_like(out[0])
        (_by_diagonals if slow[a] else _by_sums)(out[a:b], kinds[a:b], above, bpp)
    return out


def _by_sums(part: np.ndarray, kinds: np.ndarray, above: np.ndarray, bpp: int) -> None:
    if (kinds == 1).any():
        own = part[kinds == 1]
        part[kinds == 1] = np.cumsum(own.reshape(len(own), -1, bpp), axis=1, dtype=np.uint8).reshape(len(own), -1)
    if (kinds == 2).any():  # a row is the sum of the rows from the last one that does not look up
        sums = np.cumsum(np.r_[above[None], part], axis=0, dtype=np.uint8)
        base = np.maximum.accumulate(np.where(kinds != 2, np.arange(1, len(kinds) + 1), 0))
        part[:] = sums[1:] - np.where((base > 0)[:, None], sums[np.maximum(base - 1, 0)], 0)


def _by_diagonals(part: np.ndarray, kinds: np.ndarray, above: np.ndarray, bpp: int) -> None:
    height, width = len(part), part.shape[1] // bpp
    own = np.zeros((height + 1, width + 1, bpp), np.int16)
    own[0, 1:], own[1:, 1:] = above.reshape(width, bpp), part.reshape(height, width, bpp)
    average = (kinds == 3)[:, None]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = own[y + 1, x], own[y, x + 1], own[y, x]
        own[y + 1, x + 1] = (own[y + 1, x + 1] + np.where(average[y], (left + up) // 2, _paeth(left, up, corner))) & 255
    part[:] = own[1:, 1:].reshape(height, -1)


def encode_png(pixels: np.ndarray, kinds: np.ndarray | int | None = None, level: int = 3) -> bytes:
    """A PNG of height x width (x samples) bytes; kinds: the filter of each row or of all (None: the best of three)."""
    height, width, samples = *pixels.shape[:2], 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.ascontiguousarray(pixels).reshape(height, -1)
    body = np.empty((height, rows.shape[1] + 1), np.uint8)
    if kinds is None:
        kinds = best_kinds(rows, samples)
        body[:, 1:] = rows
        body[kinds == 1, 1 + samples :] -= rows[kinds == 1, :-samples]
        body[1:, 1:][kinds[1:] == 2] -= rows[:-1][kinds[1:] == 2]
    else:
        kinds = np.broadcast_to(np.asarray(kinds, np.uint8), height)
        body[:, 1:] = filter_rows(rows, kinds, samples) if kinds.any() else rows
    body[:, 0] = kinds
    colour = {v: k for k, v in SAMPLES.items()}[samples]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes, limit: int = LIMIT) -> np.ndarray:
    """Pixels of an 8-bit PNG without interlace; ValueError if anything in the file is wrong, or it holds more than `limit`
    bytes of samples."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            raise ValueError("cut chunk")
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (at == 8) or kind == b"IHDR" and size != 13:
            raise ValueError("header out of place or of the wrong size")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in SAMPLES or any(head[4:]) or not head[0] or not head[1]:
        raise ValueError("not a picture of the kinds that are read here")
    width, height, bpp = head[0], head[1], SAMPLES[head[3]]
    wanted = height * (width * bpp + 1)
    if wanted > limit:
        raise ValueError("too many samples")
    inflate = zlib.decompressobj()
    try:
        flat = inflate.decompress(b"".join(body), wanted + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(flat) != wanted or not inflate.eof:
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(flat, np.uint8).reshape(height, -1)
    pixels = unfilter_rows(rows[:, 1:], rows[:, 0], bpp)
    return pixels if bpp == 1 else pixels.reshape(height, width, bpp)


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """n means along the first axis; rows are repeated where there are fewer."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n]
    cut = np.arange(n + 1) * len(x) // n
    return np.add.reduceat(x, cut[:-1], axis=0) / np.diff(cut)[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 picture are above their median, the mean left out."""
    grey = pixels if pixels.ndim == 2 else pixels[..., : 3 if pixels.shape[2] > 2 else 1].mean(axis=2)
    small = _shrink(_shrink(grey.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def store_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """doc_id, n_bytes (without padding), media (PNG) of each row; the tile is a multiple of the width."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                data = T.column(part, "text").cast(pa.large_binary()).to_pylist()
                media = [encode_png(np.frombuffer(pad(x, tile), np.uint8).reshape(-1, width)) for x in data]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """media's columns doc_id, n_bytes, media, and of the pixels as read back: payload_bytes, payload_sha256, tail_crc32,
    feature (binary, 8 bytes), and error."""

    def of(data: bytes | None):
        try:
            pixels = decode_png(data or b"")
        except ValueError as e:
            return None, None, None, None, str(e)
        flat = pixels.tobytes()
        return len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-32:]), cosine_hash(pixels), None

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "media"):
                found = list(zip(*map(of, part.column("media").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(x, k) for x, k in zip(found, kinds, strict=True)], part.schema.names + names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature binary, error string")


def query(spark, sf_dir: str) -> DataFrame:
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_media(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature")
    )
