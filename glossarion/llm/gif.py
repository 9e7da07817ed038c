"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames.

``encode_gif`` stores a payload losslessly as 8-bit palette indices, ``WIDTH`` pixels a
line and at most ``FRAME_LINES`` lines a frame. ``decode_gif`` reads any GIF87a/89a:
global and local palettes, interlacing, transparency and the disposal methods. The
Spark operator stores a text's bytes, reads the stored bytes back and computes
columns from the decoded frames. A row is held at a time, so memory follows the
longest text, not the table.

Defined results: null and empty texts become one line of blanks; equal texts give
equal bytes; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WIDTH, FRAME_LINES, DELAY_CS = 192, 64, 10
CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
_SEGMENT = FULL - FIRST


@dataclass
class Frame:
    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray


def palette_332() -> np.ndarray:
    """256 distinct colours: three bits red, three green, two blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3], 1).astype(np.uint8)


def _schedule(min_bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the n codes after a clear code, and the bit at which each starts."""
    first = (1 << min_bits) + 2
    known = np.maximum(first - 1 + np.arange(n), (1 << min_bits) + 1)
    width = np.clip(np.ceil(np.log2(known + 1)).astype(np.int64), min_bits + 1, 12)
    return width, np.concatenate([[0], np.cumsum(width)])


_WIDTH9, _START9 = _schedule(8, _SEGMENT + 2)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples, with a clear code whenever the table is full."""
    codes: list[int] = []
    starts: list[int] = [0]
    put = codes.append
    put_clear_at = len
    table: dict[int, int] = {}
    get = table.get
    prefix, free = data[0], FIRST
    for byte in memoryview(data)[1:]:
        key = prefix << 8 | byte
        code = get(key)
        if code is None:
            put(prefix)
            table[key] = free
            free += 1
            prefix = byte
            if free == FULL:
                put(CLEAR)
                starts.append(put_clear_at(codes))
                table.clear()
                free = FIRST
        else:
            prefix = code
    put(prefix)
    put(END)
    starts.append(len(codes))
    at = np.empty(len(codes), np.int64)
    bit = 9  # after the leading clear code
    for a, b in zip(starts, starts[1:], strict=False):
        at[a:b] = bit + _START9[: b - a]
        bit += int(_START9[b - a])
    value = np.array(codes, np.int64) << (at & 7)
    n = (bit + 7) // 8
    out = np.zeros(n + 3)
    where = at >> 3
    for k in range(3):
        out += np.bincount(where + k, (value >> 8 * k) & 255, n + 3)
    out[0] += CLEAR & 255
    out[1] += CLEAR >> 8
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int, n_pixels: int) -> bytes:
    """The samples of any GIF code stream; stops at the end code or with the pixels."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = 8 * len(stream)
    width, start = (_WIDTH9, _START9) if min_bits == 8 else _schedule(min_bits, _SEGMENT + 2)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, bit = 0, 0
    fresh, table, previous = True, list(literals), b""
    while made < n_pixels:
        if fresh:  # the widths since a clear code follow from the count of codes alone
            n = min(int(np.searchsorted(start, total - bit, "right")) - 1, len(width))
            at, wide = bit + start[:n], width[:n]
        else:  # the table is full and stays so until it is cleared
            n = max(0, min((total - bit) // 12, _SEGMENT))
            at, wide = bit + 12 * np.arange(n), np.full(n, 12)
        if n <= 0:
            break
        codes = (words[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        put, add = out.append, table.append
        run = codes[:stop].tolist()
        if fresh and run:
            previous = table[run[0]]
            put(previous)
            made += len(previous)
            run = run[1:]
        room = FULL - len(table)
        for code in run[:room]:
            entry = table[code] if code < len(table) else previous + previous[:1]
            put(entry)
            add(previous + entry[:1])
            previous = entry
            made += len(entry)
        for code in run[max(room, 0) :]:
            put(table[code])
            made += len(table[code])
        if stop == n:
            bit, fresh = int(at[-1] + wide[-1]), False
            continue
        if codes[stop] == end:
            break
        bit, fresh, table = int(at[stop] + wide[stop]), True, list(literals)
    return b"".join(out)[:n_pixels]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for i in range(0, len(data), 255) if (x := data[i : i + 255])) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of ``WIDTH``."""
    lines = len(payload) // WIDTH
    out = [
        b"GIF89a", struct.pack("<HHBBB", WIDTH, min(lines, FRAME_LINES), 0xF7, 0, 0), palette_332().tobytes(),
    ]
    for top in range(0, lines, FRAME_LINES):
        n = min(FRAME_LINES, lines - top)
        samples = payload[top * WIDTH : (top + n) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0) + b"\x08" + _blocks(lzw_encode(samples)))
    return b"".join([*out, b"\x3b"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def _deinterlace(rows: np.ndarray) -> np.ndarray:
    h = len(rows)
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order, each with its indices and the canvas (RGBA) as shown."""
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            _, at = _read_blocks(data, at + 2)
            continue
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if packed & 0x80:
            n = 2 << (packed & 7)
            colours = np.zeros((256, 3), np.uint8)
            colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        min_bits = data[at]
        stream, at = _read_blocks(data, at + 1)
        samples = lzw_decode(stream, min_bits, w * h)
        indices = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if packed & 0x40:
            indices = _deinterlace(indices)
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = indices[: part.shape[0], : part.shape[1]]
        shown = np.ones(seen.shape, bool) if transparent is None else seen != transparent
        part[..., :3][shown] = colours[seen[shown]]
        part[..., 3][shown] = 255
        yield Frame(delay, disposal, transparent, left, top, indices, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the shown pixels in 64 bins, two bits a channel."""
    rgb = canvas[canvas[..., 3] > 0][:, :3].astype(np.int64) >> 6
    return np.bincount(rgb[:, 0] << 4 | rgb[:, 1] << 2 | rgb[:, 2], minlength=64)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the GIF), payload (read back), delays_cs, histogram."""
    small_batches(docs.sparkSession)
    picked = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    kind = picked.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "media", "payload", "delays_cs", "histogram")}
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                media = encode_gif(data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b" "))
                samples, delays, histogram = [], [], np.zeros(64, np.int64)
                for frame in decode_gif(media):
                    samples.append(frame.indices.tobytes())
                    delays.append(frame.delay_cs)
                    histogram += colour_histogram(frame.canvas)
                for k, v in zip(rows, (len(data), media, b"".join(samples), delays, histogram.tolist()), strict=True):
                    rows[k].append(v)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = {k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)}
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), **arrays})

    return picked.mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, delays_cs array<int>, histogram array<long>"
    )
