"""Baseline JPEG as a lossless container of bytes, and its DC-only luminance thumbnail.

The writer makes one grey 8x8 block for each byte: its DC coefficient (quantised by 8) is
the byte less 128, and all AC coefficients are 0. Differences have the usual Huffman codes
of DC categories, 2 to 6 bits and the category's extra bits, and each row of 64 blocks is a
restart interval. The reader parses any baseline file's markers and tables, interleaved or
not, and Huffman-decodes all restart intervals of many files in lockstep: at each step numpy
looks up the next code of every interval by its next 16 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, text_buffer

WIDTH = 64  # blocks in a row
MOST_ROWS = 8191  # blocks in a column: 65,528 pixels
_FRAME = WIDTH * MOST_ROWS
#: Bytes of text whose media are written and read together.
_TOGETHER = 1 << 18


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# fixed values of the JPEG standard's luminance DC table: how many codes have 1 to 16 bits, and the categories in order
_DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_DC_SYMBOLS = bytes(range(12))
# one AC code, end of block
_AC_COUNTS = bytes([1] + [0] * 15)
_AC_SYMBOLS = bytes([0])
_TABLES = _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
_RESTART = _segment(0xDD, struct.pack(">H", WIDTH))


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Length and code of each symbol."""
    code, k, found = 0, 0, {}
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            found[symbols[k]] = n, code
            code, k = code + 1, k + 1
        code <<= 1
    return found


def _words() -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block with each difference -255..255, left-aligned in 24, and how many: code, extra bits, end of block."""
    codes, word, size = _codes(_DC_COUNTS, _DC_SYMBOLS), [], []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        n, code = codes[s]
        bits = n + s + 1
        word.append((((code << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1) << (24 - bits))
        size.append(bits)
    return np.array(word, np.int64), np.array(size, np.int64)


_WORD, _SIZE = _words()


def _scans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of rows of 64 samples, and the offsets of the rows; a row is a restart interval of its own."""
    rows = len(x) // WIDTH
    level = x.reshape(rows, WIDTH).astype(np.int64)
    d = level - np.concatenate([np.full((rows, 1), 128), level[:, :-1]], 1) + 255
    size = _SIZE[d]
    end = np.cumsum(size, 1)
    length = -(-end[:, -1] // 8)
    at = np.concatenate([[0], np.cumsum(length)])
    bit = (at[:-1, None] * 8 + end - size).ravel()
    # at most 15 bits, moved by up to 7, lie in three bytes; bits of different words don't overlap, so sums are unions
    three = np.bincount(bit >> 3, weights=_WORD[d].ravel() >> (bit & 7), minlength=at[-1]).astype(np.int32)
    out = (three >> 16).astype(np.uint8)
    out[1:] |= (three[:-1] >> 8).astype(np.uint8)
    out[2:] |= three[:-2].astype(np.uint8)
    free = length * 8 - end[:, -1]  # the last byte of a row is filled with ones
    out[at[1:] - 1] |= ((1 << free) - 1).astype(np.uint8)
    return out, at


def encode_all(payload: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A JPEG stream (frames one after another for long payloads) for each payload of 64 n bytes; they lie side by side."""
    if not (np.diff(at) > 0).all() or (at % WIDTH).any():
        raise ValueError("a payload has a positive multiple of 64 bytes")
    scan, rows = _scans(payload)
    # a zero goes behind each 255, and a marker between the rows of a frame
    full = scan == 0xFF
    stuffed = np.cumsum(full) - full
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    place = np.arange(len(scan)) + stuffed + 2 * row
    out = np.zeros(len(scan) + int(full.sum()) + 2 * (len(rows) - 1), np.uint8)
    out[place] = scan
    last = rows[1:] - 1
    stop = place[last] + 1 + full[last]  # past each row's bytes, where its marker is
    start = np.concatenate([[0], stop[:-1] + 2])
    streams = []
    for lo, hi in zip((at[:-1] // WIDTH).tolist(), (at[1:] // WIDTH).tolist(), strict=True):
        parts = []
        for first in range(lo, hi, MOST_ROWS):
            past = min(first + MOST_ROWS, hi)
            marks = stop[first : past - 1]
            out[marks] = 0xFF
            out[marks + 1] = 0xD0 + np.arange(len(marks)) % 8
            frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, (past - first) * 8, WIDTH * 8, 1, 1, 0x11, 0))
            parts += [b"\xff\xd8", _TABLES, _RESTART, frame, _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), out[start[first] : stop[past - 1]].tobytes(), b"\xff\xd9"]
        streams.append(b"".join(parts))
    return streams


def encode(payload: bytes) -> bytes:
    return encode_all(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]))[0]


_known: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """symbol * 32 + code length for each 16 bits; 0 where no code starts."""
    if (counts, symbols) not in _known:
        table = np.zeros(1 << 16, np.int32)
        for s, (n, code) in _codes(counts, symbols).items():
            table[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
        if len(_known) > 64:
            _known.clear()
        _known[counts, symbols] = table
    return _known[counts, symbols]


@dataclass
class _Frame:
    """What the markers say of a frame, and the scan that has its first component."""

    height: int = 0
    width: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # identifier, across, down, quantisation table
    units: tuple = ()  # for each block of an MCU: whether it is the first component's, which component, DC and AC table
    restart: int = 0
    scan: bytes | None = None
    scale: int = 1

    def shape(self) -> tuple[int, int, int, int]:
        """Blocks of the first component: down and across in the picture, and of an MCU's, down and across."""
        most_h, most_v = max(c[1] for c in self.parts), max(c[2] for c in self.parts)
        _, h, v, _ = self.parts[0]
        down, across = -(-self.height * v // (8 * most_v)), -(-self.width * h // (8 * most_h))
        alone = len({u[1] for u in self.units}) == 1
        return (down, across, 1, 1) if alone else (down, across, v, h)

    def mcus(self) -> tuple[int, int]:
        down, across, v, h = self.shape()
        return -(-down // v), -(-across // h)


def parse(stream: bytes) -> list[_Frame]:
    """The frames of a stream; scans that lack the first component are passed over."""
    out, at = [], 0
    while at < len(stream):
        if stream[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no frame starts at {at}")
        at += 2
        quant, dc, ac, frame = {}, {}, {}, _Frame()
        while True:
            if stream[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = stream[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            n = int.from_bytes(stream[at + 2 : at + 4], "big")
            body, at = stream[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    m = sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1:17], body[17 : 17 + m]
                    body = body[17 + m :]
            elif marker == 0xC0:
                frame.height, frame.width, k = struct.unpack(">HHB", body[1:6])
                frame.parts = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(k))]
            elif marker in {0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}:
                raise ValueError("only baseline frames")
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                end = stream.index(b"\xff", at)
                while stream[end + 1] == 0 or 0xD0 <= stream[end + 1] <= 0xD7:
                    end = stream.index(b"\xff", end + 2)
                own = {body[1 + 2 * i]: (dc[body[2 + 2 * i] >> 4], ac[body[2 + 2 * i] & 15]) for i in range(body[0])}
                if frame.parts[0][0] in own:
                    sizes = {c[0]: 1 if len(own) == 1 else c[1] * c[2] for c in frame.parts}
                    frame.units = tuple((c[0] == frame.parts[0][0], c[0], own[c[0]]) for c in frame.parts if c[0] in own for _ in range(sizes[c[0]]))
                    frame.scan, frame.scale = stream[at:end], quant[frame.parts[0][3]]
                at = end
        if frame.scan is None:
            raise ValueError("a frame without a scan of its first component")
        out.append(frame)
    return out


def _intervals(frames: list[_Frame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scans' bytes side by side without stuffing and markers, the offset of each restart interval (and the end), and its blocks."""
    raw = np.frombuffer(b"".join(f.scan for f in frames), np.uint8)
    edges = np.cumsum([0, *(len(f.scan) for f in frames)])
    after = np.append(raw[1:], 0)
    full = raw == 0xFF
    stuffing, marker = np.append(False, (full & (after == 0))[:-1]), full & (after >= 0xD0) & (after <= 0xD7)
    drop = stuffing | marker
    drop[1:] |= marker[:-1]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    starts = np.sort(np.concatenate([edges[:-1], np.flatnonzero(marker) + 2]))
    blocks = []
    for f in frames:
        down, across = f.mcus()
        n = down * across
        each = f.restart or n
        blocks += [min(each, n - lo) * len(f.units) for lo in range(0, n, each)]
    if len(blocks) != len(starts):
        raise ValueError("the restart markers don't fit the frame")
    return raw[~drop], np.append(kept[starts], kept[-1]), np.array(blocks, np.int64)


def _lockstep(data: np.ndarray, at: np.ndarray, blocks: np.ndarray, units: tuple) -> np.ndarray:
    """The DC differences of all blocks, interval after interval; one Huffman code of every interval a step."""
    b = np.concatenate([data, np.full(4, 0xFF, np.uint8)]).astype(np.int32)
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    tables = np.concatenate([_lookup(*t) for _, _, pair in units for t in pair])  # DC and AC of each unit
    out = np.zeros(int(blocks.sum()), np.int32)
    kind = np.int32 if 8 * len(b) < 1 << 31 else np.int64
    bit, past = (at[:-1] * 8).astype(kind), (at[1:] * 8).astype(kind)
    slot = np.cumsum(blocks) - blocks
    left, unit, k = blocks.astype(kind), np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32)

    def peek(bit: np.ndarray) -> np.ndarray:
        if (bit > past).any():
            raise ValueError("the scan ends early")
        return (window[bit >> 3] >> (8 - (bit & 7))) & 0xFFFF

    while len(bit):
        first = k == 0
        dc = bool(first.any())
        row = first ^ True if len(units) == 1 else unit * 2 + ~first
        found = tables[(row.astype(np.int32) << 16) | peek(bit)]
        if not found.all():
            raise ValueError("no such Huffman code")
        symbol, bit = found >> 5, bit + (found & 31)
        size = symbol & 15
        if dc:
            extra = peek(bit) >> (16 - size)
            value = extra - ((extra < (1 << size >> 1)) * ((1 << size) - 1))
        bit = bit + size
        if dc and first.all():  # as all intervals of our own writer are
            out[slot] = value
            k += 1
            continue
        if dc:
            out[slot[first]] = value[first]
        k += np.where(first, 1, np.where(symbol == 0xF0, 16, np.where(size == 0, 64, (symbol >> 4) + 1)))
        done = k >= 64
        k[done] = 0
        slot, left = slot + done, left - done
        if len(units) > 1:
            unit = np.where(done, (unit + 1) % len(units), unit)
        if not left.all():
            go = left > 0
            if (bit > past)[~go].any():
                raise ValueError("the scan ends early")
            bit, past, slot, left, unit, k = (x[go] for x in (bit, past, slot, left, unit, k))
    return out


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream height, width and DC-only luminance thumbnail (one pixel a block) of its frames."""
    frames = [(i, f) for i, s in enumerate(streams) for f in parse(s)]
    pixels: dict[int, np.ndarray] = {}
    for units in dict.fromkeys(f.units for _, f in frames):  # frames with the same tables and sampling go together
        these = [j for j, (_, f) in enumerate(frames) if f.units == units]
        data, at, blocks = _intervals([frames[j][1] for j in these])
        d = _lockstep(data, at, blocks, units)
        own = np.array([u[0] for u in units])
        per = int(own.sum())
        d = d.reshape(-1, len(units))[:, own].ravel()
        ends = np.cumsum(blocks // len(units) * per)
        level = np.cumsum(d, dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        level -= np.repeat(np.where(starts > 0, level[starts - 1], 0), np.diff(np.append(starts, len(d))))
        lo = 0
        for j in these:
            f = frames[j][1]
            down, across, v, h = f.shape()
            m, n = f.mcus()
            part = level[lo : lo + m * n * per].reshape(m, n, v, h).transpose(0, 2, 1, 3).reshape(m * v, n * h)[:down, :across]
            lo += m * n * per
            pixels[j] = (np.clip(part * f.scale + 1024, 0, 2040) + 4 >> 3).clip(0, 255).astype(np.uint8)
    out: list[list] = [[] for _ in streams]
    for j, (i, f) in enumerate(frames):
        out[i].append((f.height, f.width, pixels[j]))
    return out


def decode(stream: bytes) -> list[tuple[int, int, np.ndarray]]:
    return thumbnails([stream])[0]


def thumbnail_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which cells of an 8x8 grid are lighter than the one to the left, cyclically."""
    flat = pixels.reshape(-1)
    edges = np.arange(65) * len(flat) // 64
    sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    n = np.maximum(np.diff(edges), 1)
    grid = ((sums[edges[1:]] - sums[edges[:-1]]) / n).reshape(8, 8)
    return np.packbits(grid > np.roll(grid, 1, 1)).tobytes().hex()


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as JPEG, reads the stored bytes back and describes them.

    The UTF-8 bytes (null: none), filled with zeros up to a positive multiple of 64, are the
    samples. Gives id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64
    bytes read back), media_bytes, media_sha256, feature (thumbnail hash), frames, height,
    width and, on request, the media. Equal texts give equal values; rows stay rows, also
    if repeated; other columns are left out. Each text is worked on by itself, in memory.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "height", "width"]
    kinds = [None, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, pa.string(), pa.string(), *[pa.int32()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                raw, at = text_buffer(batch.column(1))
                lo = 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _TOGETHER, "right")) - 1)
                    hi = min(hi, lo + 4096, batch.num_rows)
                    yield described(batch.column(0).slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    lo = hi

    def described(ids: pa.Array, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(at)
        places = np.concatenate([[0], np.cumsum(np.maximum(WIDTH, -(-sizes // WIDTH) * WIDTH))])
        payload = np.zeros(places[-1], np.uint8)
        payload[np.arange(len(raw)) + np.repeat(places[:-1] - at[:-1], sizes)] = raw
        media = encode_all(payload, places)
        rows = []
        for n, stored, frames in zip(sizes.tolist(), media, thumbnails(media), strict=True):
            pixels = frames[0][2] if len(frames) == 1 else np.concatenate([f[2] for f in frames])
            back = pixels.tobytes()
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), thumbnail_hash(pixels), len(frames), sum(f[0] for f in frames), frames[0][1]))
        cols = [ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
        return pa.RecordBatch.from_arrays(cols + [pa.array(media, pa.binary())] * keep_media, names + ["media"] * keep_media)

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, height int, width int"
    return df.select(id_col, text_col).mapInArrow(run, schema + ", media binary" * keep_media)
