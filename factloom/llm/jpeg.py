"""Baseline JPEG media columns, in numpy: marker parsing, Huffman decoding, DC-only thumbnails.

Decoding runs all restart intervals of a batch of images in lock step: a step reads one Huffman
symbol and its magnitude bits of every interval that still has coefficients to come. Any baseline
image with one interleaved scan is read, whatever its tables; images without restart markers are
one interval each.

``stored`` keeps arbitrary bytes losslessly in an image. JPEG's samples are lossy, so the unit is the
quantised coefficient: byte v is coefficient 256 + v, 64 bytes are one block in zigzag order, and
every block is a restart interval of its own. Coefficients 256 to 511 all have nine magnitude bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_batches, read

UNIT = 64
BASE = 256
#: Intervals decoded in lock step, and blocks encoded at once.
LANES = 8192
#: Huffman tables of stored bytes, (code lengths' counts, symbols): size 9 has the one-bit code.
DC_TABLE = (bytes([1] + [0] * 15), bytes([9]))
AC_TABLE = (bytes([1, 1, 1] + [0] * 13), bytes([0x09, 0x00, 0xF0]))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the unit."""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def shape(blocks: int) -> tuple[int, int]:
    """Nearly square (wide, high) in blocks with room for ``blocks``."""
    wide = isqrt(blocks - 1) + 1
    return wide, ceil(blocks / wide)


def stored(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are the bytes of ``payload`` (a multiple of 64)."""
    blocks = len(payload) // UNIT
    wide, high = shape(blocks)
    values = np.zeros(wide * high * UNIT, dtype=np.uint64)
    values[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    four = (values | np.uint64(BASE)).reshape(-1, 4)
    word = (four[:, 0] << np.uint64(30)) | (four[:, 1] << np.uint64(20)) | (four[:, 2] << np.uint64(10)) | four[:, 3]
    coded = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(wide * high, 80)
    out = np.empty((wide * high, 82), dtype=np.uint8)
    out[:, :80], out[:, 80], out[:, 81] = coded, 0xFF, 0xD0 + np.arange(wide * high) % 8
    if (coded == 0xFF).any():
        scan = b"".join(row[:80].tobytes().replace(b"\xff", b"\xff\0") + row[80:].tobytes() for row in out)[:-2]
    else:
        scan = out.tobytes()[:-2]
    head = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", len(payload))),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1] + b"\x10" + AC_TABLE[0] + AC_TABLE[1]),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ]
    return b"".join(head) + scan + b"\xff\xd9"


@dataclass
class Image:
    """What the markers say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    #: Per component: id, horizontal and vertical sampling, quantisation table, DC and AC table.
    parts: list[list[int]] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    scan: slice = slice(0, 0)

    @property
    def unit(self) -> list[int]:
        """Component of each block of a minimum coded unit, in order."""
        if len(self.parts) == 1:
            return [0]
        return [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]

    @property
    def units(self) -> tuple[int, int]:
        """Coded units across and down."""
        most_h, most_v = (1, 1) if len(self.parts) == 1 else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        return ceil(self.width / (8 * most_h)), ceil(self.height / (8 * most_v))


def parse(data: bytes) -> Image:
    """Markers up to the scan. Raises ValueError on anything but a one-scan baseline image."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one should be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=f">u{wide}").astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if body[0] != len(image.parts):
                raise ValueError("more than one scan")
            for i in range(body[0]):
                part = next(p for p in image.parts if p[0] == body[1 + 2 * i])
                part[4], part[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            end = data.rfind(b"\xff\xd9")
            image.scan = slice(at, end if end >= at else len(data))
            return image
    raise ValueError("no scan")


def lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Code length << 8 | symbol for each 16 bits that may come next; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, dtype=np.uint16), 0, 0
    counts, symbols = table
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return out


class Bits:
    """Bits of many intervals, each read at its own place."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        self.words = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]

    def sixteen(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, 8 * (len(self.words) - 1))
        return (self.words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    def signed(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Magnitude bits as JPEG writes them: a leading 0 means a negative value."""
        raw = (self.sixteen(at) >> (16 - size).astype(np.uint32)).astype(np.int32)
        return np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)


def intervals(images: list[Image], data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all images without stuffing and markers; the image and start of each interval."""
    scans = [np.frombuffer(d, dtype=np.uint8)[i.scan] for i, d in zip(images, data)]
    lengths = np.array([len(s) for s in scans], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    flat = np.concatenate([*scans, np.zeros(2, dtype=np.uint8)])
    marks = np.flatnonzero(flat[:-1] == 0xFF)
    follow = flat[marks + 1]
    restarts = marks[(follow >= 0xD0) & (follow <= 0xD7)]
    drop = np.concatenate([marks[follow == 0] + 1, restarts, restarts + 1])
    keep = np.ones(len(flat), dtype=bool)
    keep[drop] = False
    starts = np.sort(np.concatenate([begins, restarts + 2]))
    owner = np.searchsorted(begins, starts, side="right") - 1
    moved = np.searchsorted(np.sort(drop), starts)
    return flat[keep], owner, starts - moved


def coefficients(images: list[Image], data: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (blocks, 64) of each image, in coded and zigzag order, DC prediction undone."""
    flat, owner, starts = intervals(images, data)
    bits = Bits(flat)
    luts: dict[tuple[bytes, bytes], int] = {}
    tables: list[np.ndarray] = []

    def table(image: Image, at: int) -> int:
        if (t := image.tables[at]) not in luts:
            luts[t] = len(tables)
            tables.append(lookup(t))
        return luts[t]

    units = np.array([i.units[0] * i.units[1] for i in images], dtype=np.int64)
    steps = [np.array(i.unit) for i in images]
    dc = [np.array([table(i, p[4]) for p in i.parts]) for i in images]
    ac = [np.array([table(i, 16 + p[5]) for p in i.parts]) for i in images]
    all_luts = np.concatenate(tables)
    per = np.array([i.interval or int(u) for i, u in zip(images, units)], dtype=np.int64)
    first = np.searchsorted(owner, np.arange(len(images)))
    nth = np.arange(len(owner)) - first[owner]
    of_lane = np.clip(units[owner] - nth * per[owner], 0, per[owner])
    width = np.array([len(s) for s in steps], dtype=np.int64)
    blocks = units * width
    base = np.cumsum(blocks) - blocks
    lane_base = base[owner] + nth * per[owner] * width[owner]
    out = np.zeros((int(blocks.sum()), 64), dtype=np.int16)
    pattern = np.zeros((len(images), int(width.max())), dtype=np.int64)
    dc_of, ac_of = np.zeros((len(images), 4), dtype=np.int64), np.zeros((len(images), 4), dtype=np.int64)
    for i in range(len(images)):
        pattern[i, : width[i]], dc_of[i, : len(dc[i])], ac_of[i, : len(ac[i])] = steps[i], dc[i], ac[i]
    for a in range(0, len(owner), LANES):
        lanes = slice(a, a + LANES)
        _decode(bits, all_luts, starts[lanes] * 8, (of_lane * width[owner])[lanes], lane_base[lanes], pattern[owner[lanes]], width[owner[lanes]], dc_of[owner[lanes]], ac_of[owner[lanes]], out)
    return [out[b : b + n] for b, n in zip(base, blocks)]


def _decode(bits, luts, at, todo, dest, pattern, width, dc_of, ac_of, out) -> None:
    """Blocks of some intervals in lock step, written to their rows of ``out``."""
    predicted = np.zeros((len(at), 4), dtype=np.int32)
    for block in range(int(todo.max(initial=0))):
        lane = np.flatnonzero(todo > block)
        part = pattern[lane, block % width[lane]]
        entry = luts[(dc_of[lane, part] << 16) + bits.sixteen(at[lane])]
        if (entry == 0).any():
            raise ValueError("a code that no table has")
        size = (entry & 255).astype(np.int32)
        here = at[lane] + (entry >> 8)
        predicted[lane, part] += bits.signed(here, size)
        row = dest[lane] + block
        out[row, 0] = predicted[lane, part]
        here += size
        base = ac_of[lane, part] << 16
        k = np.ones(len(lane), dtype=np.int64)
        live = np.arange(len(lane))
        p, b, r, kk = here.copy(), base, row, k
        while len(live):
            entry = luts[b + bits.sixteen(p)]
            if (entry == 0).any():
                raise ValueError("a code that no table has")
            size = (entry & 15).astype(np.int32)
            run = ((entry >> 4) & 15).astype(np.int64)
            p = p + (entry >> 8)
            kk = kk + run
            if size.all():
                if (kk > 63).any():
                    raise ValueError("a run past the block's end")
                out[r, kk] = bits.signed(p, size)
                kk = kk + 1
            else:
                some = np.flatnonzero(size)
                if (kk[some] > 63).any():
                    raise ValueError("a run past the block's end")
                out[r[some], kk[some]] = bits.signed(p[some], size[some])
                kk = np.where(size > 0, kk + 1, np.where(run == 15, kk + 1, 64))
            p = p + size
            go_on = kk < 64
            if not go_on.all():
                here[live[~go_on]] = p[~go_on]
                live, p, b, r, kk = live[go_on], p[go_on], b[go_on], r[go_on], kk[go_on]
        at[lane] = here


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance at an eighth of the size: each block's mean, from its DC coefficient alone."""
    across, down = image.units
    unit = np.array(image.unit)
    dc = blocks[:, 0].reshape(down * across, len(unit))[:, unit == 0].astype(np.int32)
    h, v = (1, 1) if len(image.parts) == 1 else image.parts[0][1:3]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    step = int(image.quantisers[image.parts[0][3]][0])
    own_w, own_h = ceil(image.width / 8), ceil(image.height / 8)
    return np.clip(((grid * step) >> 3) + 128, 0, 255).astype(np.uint8)[:own_h, :own_w]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits, 16 hex digits: which of 8 x 8 sampled places is brighter than their mean."""
    h, w = thumb.shape
    small = thumb[np.ix_(np.arange(8) * h // 8, np.arange(8) * w // 8)].astype(np.int32)
    return np.packbits(small.ravel() * 64 > small.sum()).tobytes().hex()


def described(image: Image, blocks: np.ndarray) -> str:
    """Dimensions, hash and checksum of the thumbnail."""
    thumb = thumbnail(image, blocks)
    return f"{image.width}x{image.height}:{thumbnail_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    """Bytes that ``stored`` put into an image."""
    (size,) = struct.unpack(">Q", image.comment)
    values = blocks.reshape(-1)[:size] - BASE
    if len(values) != size or ((values < 0) | (values > 255)).any():
        raise ValueError("no stored bytes")
    return values.astype(np.uint8).tobytes()


def decoded(media: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Markers and coefficients of images, decoded together in groups of bounded size."""
    out, group, size = [], [], 0
    for i, data in enumerate(media):
        group.append(data)
        size += len(data)
        if size >= 96 * LANES or i + 1 == len(media):
            images = [parse(d) for d in group]
            out += zip(images, coefficients(images, group))
            group, size = [], 0
    return out


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each row's whole text (null: empty) stored in an image; rows pass one by one."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def store(batch: pa.RecordBatch) -> dict:
        keys, texts = columns_of(batch, "k", "t")
        data = [(t or "").encode() for t in texts]
        return {"k": keys, "n": [len(d) for d in data], "m": pa.array([stored(padded(d)) for d in data], pa.binary())}

    return map_batches(rows, store, f"k {rows.schema['k'].dataType.simpleString()}, n long, m binary").toDF(key, "n_bytes", "media")


def media_features(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """What the stored images hold when they are read back, and their thumbnails' features."""
    rows = media.select(F.col(key).alias("k"), F.col("n_bytes").alias("n"), F.col("media").alias("m"))

    def features(batch: pa.RecordBatch) -> dict:
        keys, sizes, images = columns_of(batch, "k", "n", "m")
        out: dict[str, list] = {n: [] for n in ("b", "s", "c", "f")}
        for image, blocks in decoded(images):
            payload = payload_of(image, blocks)
            for n, v in zip("bscf", (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), described(image, blocks))):
                out[n].append(v)
        return {"k": keys, "n": sizes, "b": out["b"], "s": out["s"], "c": out["c"], "mb": [len(m) for m in images], "ms": [hashlib.sha256(m).hexdigest() for m in images], "f": out["f"]}

    schema = f"k {rows.schema['k'].dataType.simpleString()}, n long, b long, s string, c long, mb long, ms string, f string"
    return map_batches(rows, features, schema).toDF(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of media columns per document, read back from the stored bytes."""
    return media_features(media_column(read(spark, sf_dir, "documents")))
