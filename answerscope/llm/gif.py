"""GIF media column: write payloads as GIF, decode LZW streams, compose timed frames.

``encode`` stores a payload's bytes as palette indices of frames ``WIDTH``
samples wide. ``decode`` reads any GIF: it decodes the LZW code stream of each
image, applies local or global palettes, transparency and disposal, and gives
timed frames with their samples and colour histograms.

Code widths of an LZW stream depend only on the number of codes since the last
clear code, so codes are cut from the bit stream, and packed into it, a whole
block at a time; only the strings are built code by code.

Defined results: a null payload is an empty one; an empty payload gives a file
without frames (the query pads it first); damaged streams, cut palettes, code
sizes out of range, images that their stream can't fill and screens of more
than MOST_PIXELS give the frames before the damage; repeated rows give equal
files; an empty table gives no rows; a very long payload is worked on frame by
frame, and takes a few times its own size of memory; other columns are kept,
and those of the added names replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH, ROWS, DELAY_CS = 192, 64, 4
MOST_CODES = 4096
#: Pixels of the largest screen that is decoded; more can't be held by a task.
MOST_PIXELS = 1 << 26
#: Bins of a colour histogram: two bits each of red, green and blue.
BINS = 64
FRAME = "struct<frame:int,start_ms:long,duration_ms:int,width:int,height:int,samples:binary,histogram:array<int>>"


# --- LZW ---------------------------------------------------------------------


@lru_cache(maxsize=16)
def schedule(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each."""
    entries = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    widths = np.clip(np.frexp(entries.astype(float))[1], min_size + 1, 12)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def to_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    start = ends - widths
    at, shifted = start >> 3, codes << (start & 7)
    # bits of different codes never meet, so that their bytes add up
    n = int(ends[-1] + 7 >> 3)
    total = sum(np.bincount(at + i, (shifted >> 8 * i) & 255, n + 2) for i in range(3))
    return total[:n].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    clear = 1 << min_size
    most, fresh = MOST_CODES << 8, clear + 2 << 8
    # strings by number: the code of all but the last sample, times 256, plus that; codes are kept times 256
    table: dict[int, int] = {}
    get, codes, blocks = table.get, [clear << 8], []
    push, code = codes.append, fresh
    prefix = data[0] << 8 if data else None
    for byte in data[1:]:
        if (longer := get(prefix | byte)) is not None:
            prefix = longer
            continue
        push(prefix)
        if code < most:
            table[prefix | byte] = code
            code += 256
        else:
            blocks.append(codes)
            codes = [clear << 8]
            push, code = codes.append, fresh
            table.clear()
        prefix = byte << 8
    if prefix is not None:
        push(prefix)
    push(clear + 1 << 8)
    blocks.append(codes)
    after, _ = schedule(min_size, MOST_CODES)
    # a block's last width is that of the clear code after it
    widths = np.concatenate([[min_size + 1], *[after[: len(block)] for block in blocks]])[:-1]
    return to_bits(np.concatenate(blocks) >> 8, widths)


def lzw_decode(stream: bytes, min_size: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream; what comes before any damage."""
    clear = 1 << min_size
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    n_bits, at, out, size = len(stream) * 8, 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, seen = list(roots), b"", 0  # seen: codes since the last clear code
    while at < n_bits and size < most:
        widths, before = schedule(min_size, seen + MOST_CODES)
        offset = at + before[seen : seen + MOST_CODES] - before[seen]
        width = widths[seen : seen + MOST_CODES]
        inside = int(np.searchsorted(offset + width, n_bits, "right"))
        offset, width = offset[:inside], width[:inside]
        if not inside:
            break
        byte = offset >> 3
        raw = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        codes = (raw >> (offset & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes & ~1) == clear)
        n = int(stops[0]) if len(stops) else inside
        found = codes[:n].tolist()
        done = len(out)
        first = 0
        if not seen and n:
            if found[0] >= clear:
                break
            last = roots[found[0]]
            out.append(last)
            first = 1
        room = max(MOST_CODES - len(table), 0)
        add, push = table.append, out.append
        whole = True
        for code in found[first : first + room]:
            try:
                now = table[code]
            except IndexError:
                if code != len(table):
                    whole = False
                    break
                now = last + last[:1]
            add(last + now[:1])
            push(now)
            last = now
        if whole and first + room < n:  # a full table learns nothing more
            out += [table[code] for code in found[first + room :]]
            last = out[-1]
        size += sum(map(len, out[done:]))
        if not whole:
            break
        seen += n
        if len(stops):
            if codes[n] == clear + 1:
                break
            at = int(offset[n] + width[n])
            table, seen = list(roots), 0
        else:
            at = int(offset[-1] + width[-1])
    return b"".join(out)[:most]


# --- the file ----------------------------------------------------------------


def sub_blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


GREYS = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose palette indices are the bytes of ``payload``, whose length is a multiple of ``width``."""
    step = width * rows
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, max(1, len(payload) // width)), 0xF7, 0, 0), GREYS]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out.append(sub_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    duration_ms: int
    width: int
    height: int
    samples: bytes
    histogram: list[int]  # of the composed screen's opaque pixels
    canvas: np.ndarray | None = None  # height x width x 4 of the composed screen


def colours(raw: bytes) -> np.ndarray:
    """256 opaque colours, those not given black."""
    table = np.zeros((256, 4), dtype=np.uint8)
    given = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
    table[: len(given), :3] = given
    table[:, 3] = 255
    return table.view("<u4")[:, 0]


def histogram(canvas: np.ndarray) -> list[int]:
    index = (canvas & 0xC0) >> 2 | (canvas & 0xC000) >> 12 | (canvas & 0xC00000) >> 22
    return np.bincount(index[canvas > 0xFFFFFF], minlength=BINS).tolist()


def row_order(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(raw: bytes, canvases: bool = False) -> Iterator[Frame]:
    """The frames of a file one by one, up to its first damage; with their ``canvases`` if asked for."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return
    width, height, flags, _, _ = struct.unpack("<HHBBB", raw[6:13])
    if width * height > MOST_PIXELS:
        return
    at, palette = 13, colours(b"")
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        if at + size > len(raw):
            return
        palette, at = colours(raw[at : at + size]), at + size
    screen = np.zeros((height, width), dtype="<u4")
    delay, disposal, clear_index, clock = 0, 0, None, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(raw) and raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        return b"".join(parts), at + 1

    while at < len(raw):
        kind = raw[at]
        if kind == 0x21 and at + 1 < len(raw):
            body, after = blocks(at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = after
        elif kind == 0x2C and at + 11 <= len(raw):
            x, y, w, h, packed = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
            at += 10
            own = palette
            if packed & 0x80:
                size = 3 << (packed & 7) + 1
                if at + size >= len(raw):
                    return
                own, at = colours(raw[at : at + size]), at + size
            min_size = raw[at]
            stream, at = blocks(at + 1)
            # a code stands for fewer than MOST_CODES samples, so a short stream can't fill a large image
            if not 1 <= min_size <= 8 or w * h > len(stream) * 8 // (min_size + 1) * MOST_CODES:
                return
            samples = lzw_decode(stream, min_size, w * h)
            if len(samples) < w * h:
                return
            image = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
            if packed & 0x40:
                image = image[np.argsort(row_order(h, True))]
                samples = image.tobytes()
            before = screen.copy() if disposal == 3 else None
            part = screen[y : y + h, x : x + w]
            inside = image[: part.shape[0], : part.shape[1]]
            if clear_index is None:
                part[:] = own[inside]
            else:
                np.copyto(part, own[inside], where=inside != clear_index)
            yield Frame(clock, delay * 10, w, h, samples, histogram(screen), screen.copy().view(np.uint8).reshape(height, width, 4) if canvases else None)
            clock += delay * 10
            if disposal == 2:
                part[:] = 0
            elif before is not None:
                screen = before
            delay, disposal, clear_index = 0, 0, None
        else:
            return


# --- Spark -------------------------------------------------------------------


#: Bytes of payloads that a task remembers the file of; a bound on memory only.
REMEMBERED = 8 << 20
FRAME_TYPE = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("duration_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int32()))])


def _mapped(docs: DataFrame, column: str, added: dict[str, tuple[str, pa.DataType]], make) -> DataFrame:
    """``docs`` with columns that ``make`` gives for ``column``, some bytes at a time; columns of these names are replaced."""
    docs = docs.drop(*added)
    fields = docs.schema.fields
    place, names = [f.name for f in fields].index(column), [*[f.name for f in fields], *added]
    schema = T.StructType([*fields, *T.StructType.fromDDL(", ".join(f"`{name}` {ddl}" for name, (ddl, _) in added.items())).fields])
    kinds = [kind for _, kind in added.values()]

    def run(batches):
        known: dict[bytes, tuple] = {}  # equal payloads are made once
        size = 0
        for batch in batches:
            for a, b in blocks_of_bytes(batch.column(place)):
                part = batch.slice(a, b - a)
                rows = []
                for x in part.column(place).to_pylist():
                    x = x or b""
                    made = known.get(x)
                    if made is None:
                        made = make(x)
                        if len(x) <= REMEMBERED >> 6:
                            size += 4 * len(x)
                            if size > REMEMBERED:
                                known, size = {}, 4 * len(x)
                            known[x] = made
                    rows.append(made)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)

    return docs.mapInArrow(run, schema)


def blocks_of_bytes(values: pa.Array, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges with about ``most`` bytes each."""
    sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _rows(frames: Iterator[Frame], samples: bool = True) -> list[dict]:
    return [dict(frame=i, start_ms=f.start_ms, duration_ms=f.duration_ms, width=f.width, height=f.height, samples=f.samples if samples else None, histogram=f.histogram) for i, f in enumerate(frames)]


def with_gif(docs: DataFrame, payload: str = "payload", name: str = "gif") -> DataFrame:
    """``docs`` with a binary column: the GIF of the ``payload`` bytes."""
    return _mapped(docs, payload, {name: ("binary", pa.binary())}, lambda x: (encode(x),))


def with_frames(docs: DataFrame, gif: str = "gif", name: str = "frames") -> DataFrame:
    """``docs`` with the timed frames of a GIF column; explode it for a row per frame."""
    return _mapped(docs, gif, {name: (f"array<{FRAME}>", pa.list_(FRAME_TYPE))}, lambda x: (_rows(decode(x)),))


def with_media(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """``docs`` with ``gif``, the file of the payload, and, read back from it, ``frames`` (their samples null) and all their ``samples`` in turn."""

    def make(x: bytes) -> tuple[bytes, bytes, list[dict]]:
        stored = encode(x)
        samples: list[bytes] = []
        frames = _rows((samples.append(f.samples) or f for f in decode(stored)), samples=False)
        return stored, b"".join(samples), frames

    return _mapped(docs, payload, {"gif": ("binary", pa.binary()), "samples": ("binary", pa.binary()), "frames": (f"array<{FRAME}>", pa.list_(FRAME_TYPE))}, make)
