"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed
frames and colour histograms.

`decode` reads any GIF (87a or 89a, global and local palettes, interlaced rows,
clear codes anywhere, full tables) and composes its frames. `encode` writes
indexed frames with a real LZW table. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import encoded

#: The payload is padded to a multiple of this, one row of the stored frames.
ROW = 576
#: Codes read ahead at first; eight times as many where no clear code is among them.
RUN = 1 << 13
#: Rows of one frame: a longer payload goes on in further frames.
FRAME_ROWS = 64
PAD = b"\xff"
#: 256 different colours: three bits of a byte are its red, three its green, two its blue.
PALETTE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))
_BIT = np.arange(16)
_EIGHT = ((np.arange(256) * 7 + 127) // 255).astype(np.uint8)
_FOUR = ((np.arange(256) * 3 + 127) // 255).astype(np.uint8)
_SINGLES = [bytes([i]) for i in range(256)]


class GifError(ValueError):
    """The bytes are not a GIF that can be read."""


@dataclass
class Frame:
    """A composed frame: the whole canvas as it is shown, and for how long."""

    pixels: np.ndarray  # height x width x 4, RGBA
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height of what was drawn


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    loops: int | None = None


# --- LZW ------------------------------------------------------------------------


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the n codes after a clear code: each but the first adds an entry,
    and a code grows once the next entry needs it, up to 12 bits."""
    entries = (1 << size) + 1 + np.arange(n)
    return np.minimum(np.floor(np.log2(np.maximum(entries, 1 << size))).astype(np.int64) + 1, 12)


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """Codes of a GIF's image data, first code a clear code, last the end code."""
    clear, end = 1 << size, (1 << size) + 1
    codes: list[int] = []
    runs: list[int] = []  # codes after each clear code
    table: dict[int, int] = {}
    entry, since, now = end + 1, 0, -1
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        known = table.get(key)
        if known is not None:
            now = known
            continue
        codes.append(now)
        now = byte
        if entry < 4096:
            table[key] = entry
            entry += 1
        else:
            codes.append(clear)
            runs.append(len(codes) - since)
            since, entry, table = len(codes), end + 1, {}
    if now >= 0:
        codes.append(now)
    codes.append(end)
    runs.append(len(codes) - since)
    widths = np.concatenate([[size + 1], *[_widths(n, size) for n in runs]])
    values = np.array([clear, *codes], dtype="<u2")
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[_BIT < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """The first `most` indices of a code stream; a stream that ends early, or has
    no end code, gives what it holds."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total = 8 * len(data)
    base = [*_SINGLES[:clear], b"", b""]
    out: list[bytes] = []
    made, at, ahead = 0, 0, RUN
    while at + size + 1 <= total and made < most:
        # The codes up to the next clear code have widths that follow from their number.
        n = min(ahead, (total - at) // (size + 1))
        widths = _widths(n, size)
        stops = at + np.cumsum(widths)
        n = int(np.searchsorted(stops, total, side="right"))
        widths, starts = widths[:n], stops[:n] - widths[:n]
        byte = starts >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else n
        if upto == n == ahead and int(stops[n - 1]) + 12 <= total:
            ahead *= 8
            continue
        parts = _strings(codes[:upto].tolist(), base, clear)
        out += parts
        made += sum(map(len, parts))
        if upto == n or codes[upto] == end:
            break
        at, ahead = int(stops[upto]), RUN
    return b"".join(out)[:most]


def _strings(codes: list[int], base: list[bytes], clear: int) -> list[bytes]:
    """What each code between two clear codes stands for."""
    if not codes:
        return []
    before = base[codes[0]] if codes[0] < clear else None
    if before is None:
        raise GifError("a code before its entry")
    table, free, out = base[:], len(base), [before]
    add, put = table.append, out.append
    for code in codes[1:]:
        if code < free:
            now = table[code]
            if free < 4096:
                add(before + now[:1])
                free += 1
        elif code == free < 4096:
            now = before + before[:1]
            add(now)
            free += 1
        else:
            raise GifError("a code before its entry")
        put(now)
        before = now
    return out


# --- the file -------------------------------------------------------------------


def _part(data: bytes, at: int, n: int) -> bytes:
    """n bytes from a place; a file that ends before them raises GifError."""
    if at + n > len(data):
        raise GifError(f"the file ends at {len(data)}, inside the {n} bytes from {at}")
    return data[at : at + n]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of data sub-blocks and the place after their end; blocks that the
    file's end cuts give what they hold."""
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(s, rows, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Gif:
    """Read a GIF and compose its frames; see frames_of."""
    gif = header(data)
    gif.frames.extend(frames_of(data, gif))
    return gif


def header(data: bytes) -> Gif:
    """A GIF's size; bytes that are no GIF raise GifError."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    return Gif(*struct.unpack("<HH", data[6:10]))


def frames_of(data: bytes, gif: Gif) -> Iterator[Frame]:
    """The frames of a GIF one after another, composed on a transparent canvas; the
    number of loops goes into gif.

    Disposal 2 clears a frame's box before the next frame, 3 restores what was
    there; a transparent index leaves the canvas. Indices beyond the palette are
    black. A frame whose image data the file's end cuts draws what it holds. A file
    that ends inside a header or palette, a frame without a palette, or an unknown
    block, raises GifError.
    """
    width, height, flags = gif.width, gif.height, data[10]
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common, at = _part(data, at, n), at + n
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, hidden = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = _part(data, at + 1, 1)[0]
            body, after = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack("<BHB", body[:4])
                delay, disposal, hidden = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = struct.unpack("<H", body[12:14])[0]
            at = after
            continue
        if kind != 0x2C:
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, packed = struct.unpack("<HHHHB", _part(data, at + 1, 9))
        at += 10
        palette = common
        if packed & 0x80:
            n = 3 << (packed & 7) + 1
            palette, at = _part(data, at, n), at + n
        if palette is None:
            raise GifError("a frame without a palette")
        size = _part(data, at, 1)[0]
        if not 1 <= size <= 8:
            raise GifError("a code size out of range")
        stream, at = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, size, w * h), dtype=np.uint8)
        shown = None  # everywhere
        if len(index) < w * h:  # a stream cut short draws what it holds
            shown = np.arange(w * h) < len(index)
            index = np.concatenate((index, np.zeros(w * h - len(index), dtype=np.uint8)))
        if hidden is not None:
            shown = index != hidden if shown is None else shown & (index != hidden)
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[:, 3] = 255
        rgb = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        colours[: len(rgb), :3] = rgb
        image = colours[index].reshape(h, w, 4)
        shown = shown if shown is None else shown.reshape(h, w)
        if packed & 0x40:
            order = _interlaced(h)
            image, shown = _placed(image, order), shown if shown is None else _placed(shown, order)
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        image = image[: part.shape[0], : part.shape[1]]
        if shown is None:
            part[:] = image
        else:
            inside = shown[: part.shape[0], : part.shape[1]]
            part[inside] = image[inside]
        yield Frame(canvas.copy(), delay, (left, top, w, h))
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, hidden = 0, 0, None


def _placed(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(rows)
    out[order] = rows
    return out


def encode(frames: list[np.ndarray], palette: bytes = PALETTE, delay_ms: int = 100, disposal: int = 1) -> bytes:
    """A looping GIF89a of indexed frames (height x width, uint8), drawn from the
    top left corner of a canvas that holds the largest."""
    height, width = (max(f.shape[k] for f in frames) for k in (0, 1))
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        stream = lzw_encode(f.tobytes())
        out += [bytes([len(p)]) + p for p in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


# --- texts as media -------------------------------------------------------------


def store(payload: bytes) -> bytes:
    """A payload (a positive multiple of ROW bytes) as frames of a GIF, a byte a
    pixel's palette index."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    return encode([image[i : i + FRAME_ROWS] for i in range(0, len(image), FRAME_ROWS)])


def payload_of(frame: Frame) -> bytes:
    """The bytes back from a composed frame: the index of each pixel's colour in
    PALETTE, whose levels are far enough apart to be told by rounding."""
    left, top, w, h = frame.box
    p = frame.pixels[top : top + h, left : left + w]
    return (_EIGHT[p[..., 0]] << 5 | _EIGHT[p[..., 1]] << 2 | _FOUR[p[..., 2]]).tobytes()


def histogram(frame: Frame, bins: int = 4) -> list[int]:
    """Opaque pixels by colour, `bins` levels a channel."""
    left, top, w, h = frame.box
    p = frame.pixels[top : top + h, left : left + w].reshape(-1, 4)
    level = (np.arange(256) * bins // 256).astype(np.int32)
    place = level[p[:, 0]] * bins**2 + level[p[:, 1]] * bins + level[p[:, 2]]
    solid = p[:, 3] > 0
    return np.bincount(place if solid.all() else place[solid], minlength=bins**3).tolist()


_MEDIA = "n_bytes long, gif binary, width int, height int, frames array<struct<delay_ms:int,left:int,top:int,width:int,height:int,histogram:array<int>>>, payload binary"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a GIF and read it back.

    Returns one row per input row: id, n_bytes (of the UTF-8 text), gif (the
    stored bytes), width, height, frames (delay, box and colour histogram of each)
    and payload (the bytes read back, padded). A null or empty text is one row of
    padding. Equal texts give equal values. Other columns are not read.
    """
    frame = pa.struct([("delay_ms", pa.int32()), *((c, pa.int32()) for c in ("left", "top", "width", "height")), ("histogram", pa.list_(pa.int32()))])
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(frame), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            while done < b.num_rows:  # bounded output batches, whatever the texts' lengths
                rows, size, at = [], 0, done
                while at < b.num_rows and size < 8 << 20:
                    rows.append(_stored(b.column(1)[at].as_py() or ""))
                    size += len(rows[-1][1]) + len(rows[-1][5])
                    at += 1
                columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, at - done), *columns], names=["id", "n_bytes", "gif", "width", "height", "frames", "payload"])
                done = at

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {_MEDIA}")


def _stored(text: str) -> tuple:
    raw = encoded(text)
    data = store(raw + PAD * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)))
    gif = header(data)
    frames, payload = [], []
    for f in frames_of(data, gif):  # a long text has many frames: one is held at a time
        frames.append({"delay_ms": f.delay_ms, "left": f.box[0], "top": f.box[1], "width": f.box[2], "height": f.box[3], "histogram": histogram(f)})
        payload.append(payload_of(f))
    return len(raw), data, gif.width, gif.height, frames, b"".join(payload)


def digests(stored: DataFrame) -> DataFrame:
    """The digest columns of `media` rows, and their timed frames (delay, box and
    colour histogram of each), by native functions."""
    total = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["histogram"][k]))
    return stored.select(
        "id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).cast("long").alias("tail_crc32"),
        F.length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"),
        F.concat_ws(",", F.filter(F.transform(total, lambda n, k: F.when(n > 0, F.concat_ws(":", k.cast("string"), n.cast("string")))), lambda s: s.isNotNull())).alias("feature"),
        F.size("frames").cast("long").alias("n_frames"),
        F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"]).alias("duration_ms"), "frames",
    )
