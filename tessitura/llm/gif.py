"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``decode_gif`` reads GIF87a/89a files: logical screen, global and local palettes, graphic control (delay, disposal,
transparent colour), interlacing, and LZW streams of any minimum code size. ``frames`` of a media column are composed
full-screen RGBA images with their times. ``encode_gif`` stores bytes losslessly as 8-bit palette indices.

The width of a code follows from its place after the last clear code alone, so streams are cut into codes by array
operations, a whole table's life at a time; only the growing string table itself is walked code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import plus, table, text_batches

WIDTH = 64
#: Rows of a frame at most; longer payloads go on in further frames.
ROWS = 1024
DELAY = 10
#: Pixels of a screen that are composed at most (four bytes each).
MOST_PIXELS = 1 << 26
TOP = 4096


def _widths(bits: int, n: int) -> np.ndarray:
    """Bit widths of the first ``n`` codes after a clear code, for literals of ``bits`` bits."""
    size = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.frexp(size.astype(float))[1], 12).astype(np.int64)


_SCHEDULE = {b: _widths(b, TOP + 8) for b in range(2, 9)}


# --- LZW ------------------------------------------------------------------------------------------------------------


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples; the table starts anew when it is full."""
    clear, end = 256, 257
    codes: list[int] = []
    lengths: list[int] = []  # codes of each life of the table, its closing clear or end code included
    emit, at, n = codes.append, 0, 0
    grown: dict[int, int] = {}
    find, free = grown.get, 258
    symbols = iter(data)
    prefix = next(symbols, None)
    if prefix is not None:
        for c in symbols:
            key = prefix << 8 | c
            longer = find(key)
            if longer is not None:
                prefix = longer
                continue
            emit(prefix)
            prefix = c
            if free < TOP:
                grown[key] = free
                free += 1
            else:
                emit(clear)
                lengths.append(len(codes) - at)
                at = len(codes)
                grown.clear()
                free = 258
        emit(prefix)
    emit(end)
    lengths.append(len(codes) - at)
    schedule = _SCHEDULE[8]
    widths = np.concatenate([np.array([9]), *(schedule[:n] for n in lengths)])
    values = np.array([clear, *codes], np.int64)
    bits = (values[:, None] >> np.arange(12)) & 1
    return np.packbits(bits.astype(bool)[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """``size`` samples of an LZW stream with literals of ``bits`` bits; a short or broken stream is an error."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    flat = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    flat = np.concatenate([flat, np.zeros(16, np.uint8)])
    total, place, out, got = len(flat) - 16, 0, [], 0
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    schedule = _SCHEDULE[bits]
    grow = TOP - first + 1  # codes of a life that can add to the table, the first of which adds nothing
    powers = 1 << np.arange(12)
    while got < size and place < total:
        # the codes of one life, found by their places alone
        codes: list[np.ndarray] = []
        closed, widths = False, schedule
        while not closed and place < total:
            offsets = place + np.cumsum(widths) - widths
            inside = offsets + widths <= total
            offsets, own = offsets[inside], widths[inside]
            if not len(offsets):
                place = total
                break
            found = flat[offsets[:, None] + np.arange(12)] @ powers & ((1 << own) - 1)
            stop = np.flatnonzero((found == clear) | (found == end))
            if len(stop):
                codes.append(found[: stop[0]])
                place = total if found[stop[0]] == end else int(offsets[stop[0]] + own[stop[0]])
                closed = True
            else:
                codes.append(found)
                place = int(offsets[-1] + own[-1])
                widths = np.full(TOP, 12)
        life = np.concatenate(codes).tolist() if codes else []
        if not life:
            continue
        strings = literals.copy()
        add, put = strings.append, out.append
        if life[0] >= clear:
            raise ValueError("broken LZW stream")
        last = strings[life[0]]
        put(last)
        before, known = len(out), first
        for code in life[1:grow]:
            if code < known:
                string = strings[code]
            elif code == known:
                string = last + last[:1]
            else:
                raise ValueError("broken LZW stream")
            put(string)
            add(last + string[:1])
            known += 1
            last = string
        for code in life[grow:]:  # a full table stays as it is
            put(strings[code])
        got += sum(map(len, out[before - 1 :]))
    data = b"".join(out)
    if len(data) < size:
        raise ValueError("short LZW stream")
    return data[:size]


# --- files ----------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """One image of a file: its place, palette indices, colours, and how and when it is shown."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Bytes as rows of ``width`` palette indices (grey i for byte i), ``rows`` a frame at most; len % width must be 0."""
    height = len(payload) // width
    screen = min(height, rows)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", width, screen, 0xF7, 0, 0), grey]
    for at in range(0, height, rows):
        own = payload[at * width : (at + rows) * width]
        stream = lzw_encode(own)
        blocks = b"".join(bytes([len(b)]) + b for b in (stream[i : i + 255] for i in range(0, len(stream), 255)))
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(own) // width, 0), b"\x08", blocks, b"\0"]
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """(width, height, frames) of a GIF file; ValueError if it isn't one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    try:
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, np.zeros((0, 3), np.uint8)
        if flags & 0x80:
            shared, at = _colours(data, at, flags)
        frames, delay, disposal, transparent = [], 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9:
                    control, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, transparent = control >> 2 & 7, index if control & 1 else None
            elif data[at] == 0x2C:
                left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = shared
                if own & 0x80:
                    palette, at = _colours(data, at, own)
                bits = data[at]
                stream, at = _blocks(data, at + 1)
                indices = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8).reshape(h, w)
                if own & 0x40:
                    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                    straight = np.empty_like(indices)
                    straight[order] = indices
                    indices = straight
                frames.append(Frame(left, top, indices, palette, 10 * delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("broken GIF file")
    except (IndexError, struct.error, KeyError) as error:
        raise ValueError("broken GIF file") from error
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame], canvas: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The whole screen as RGBA after each frame, by palettes, transparency and disposal, on an empty canvas or a given one.

    The next frame may overwrite what was yielded. A screen of more than ``MOST_PIXELS`` is an error, as a file of a few
    bytes can claim any.
    """
    if width * height > MOST_PIXELS:
        raise ValueError("the screen is too large")
    if canvas is None:
        canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        h, w = f.indices.shape
        h, w = min(h, max(height - f.top, 0)), min(w, max(width - f.left, 0))
        indices = f.indices[:h, :w]
        colours = _opaque(f.palette)
        place = canvas[f.top : f.top + h, f.left : f.left + w]
        before = canvas.copy() if f.disposal == 3 else None
        if f.transparent is None:
            place[:] = colours[indices]
        else:
            shown = indices != f.transparent
            place[shown] = colours[indices[shown]]
        yield canvas
        if f.disposal == 2:
            place[:] = 0
        elif before is not None:
            canvas = before


def _opaque(palette: np.ndarray) -> np.ndarray:
    colours = np.zeros((256, 4), np.uint8)
    colours[: len(palette), :3] = palette
    colours[:, 3] = 255
    return colours


def colour_histogram(image: np.ndarray, bins: int = 16) -> np.ndarray:
    """Counts of opaque pixels per bin of each of red, green and blue."""
    opaque = image[image[..., 3] > 0]
    step = 256 // bins
    return np.stack([np.bincount(opaque[:, c] // step, minlength=bins) for c in range(3)])


# --- columns --------------------------------------------------------------------------------------------------------


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % 64 if data else 64)


def store_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes and media (a GIF file) of every row; null text is stored as empty."""
    text_batches(docs.sparkSession)
    slim = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_media_text"))
    schema = plus(slim.drop("_media_text").schema, "n_bytes long, media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo in range(0, len(texts), 256):
                some = texts.slice(lo, 256).to_pylist()
                media = [encode_gif(payload_of(t)) for t in some]
                kept = [c.slice(lo, len(some)) for c in batch.columns[:-1]]
                yield pa.record_batch([*kept, pa.array([len(t.encode()) for t in some], pa.int64()), pa.array(media, pa.binary())], schema.names)

    return slim.mapInArrow(run, schema)


FRAME_TYPE = "array<struct<time_ms:bigint,delay_ms:bigint,width:int,height:int,histogram:array<array<bigint>>>>"
ARROW_FRAMES = pa.list_(pa.struct([("time_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.list_(pa.int64())))]))


def timed_frames(data: bytes | None, red: list[bytes] | None = None) -> list[dict] | None:
    """Time, delay, screen size and colour histogram of each composed frame; None if the file can't be read.

    ``red`` receives the red samples of each frame's own place, which are what ``encode_gif`` stored.
    """
    time, told = 0, []

    def tell(f: Frame, histogram: np.ndarray, own: np.ndarray) -> None:
        nonlocal time
        told.append({"time_ms": time, "delay_ms": f.delay_ms, "width": w, "height": h, "histogram": histogram.tolist()})
        time += f.delay_ms
        if red is not None:
            red.append(own.tobytes())

    try:
        w, h, frames = decode_gif(data or b"")
        if w * h > MOST_PIXELS:
            raise ValueError("the screen is too large")
        # frames that cover the screen hide what was before, so their palettes' counts are all there is to tell
        last = None
        for i, f in enumerate(frames):
            if f.indices.shape != (h, w) or f.left or f.top or f.transparent is not None or f.disposal > 1:
                break
            colours, counts = _opaque(f.palette), np.bincount(f.indices.ravel(), minlength=256)
            tell(f, np.stack([np.bincount(colours[:, c] >> 4, counts, 16) for c in range(3)]).astype(np.int64), colours[:, 0][f.indices])
            last = f
        else:
            return told
        canvas = None if last is None else _opaque(last.palette)[last.indices]
        for f, image in zip(frames[i:], compose(w, h, frames[i:], canvas), strict=True):
            tell(f, colour_histogram(image), image[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1], 0])
    except (ValueError, MemoryError):
        return None
    return told


def frame_columns(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Every column of ``media`` and frames: time, delay, screen size and colour histogram of each composed frame.

    Null media, files that can't be read, and screens of more than ``MOST_PIXELS`` have null frames. Repeated rows stay; an
    empty table gives no rows.
    """
    schema = plus(media.schema, f"frames {FRAME_TYPE}")
    at = media.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                yield pa.record_batch([*some.columns, pa.array([timed_frames(v.as_py()) for v in some.column(at)], ARROW_FRAMES)], schema.names)

    return media.mapInArrow(run, schema)


def read_payloads(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and what the stored file says: digests of payload and file, its timed frames (as ``frame_columns``
    has them) and a feature made of these: number of frames, their whole time, and colour counts over all frames.

    Null media, and files that can't be read, have null figures. Repeated rows stay; an empty table gives no rows.
    """
    slim = media.select("doc_id", "n_bytes", "media")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), ARROW_FRAMES, pa.string()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some, rows = batch.slice(lo, 64), []
                for doc_id, n, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2), strict=True):
                    data, red = value.as_py(), []
                    frames = timed_frames(data, red)
                    if frames is None:
                        rows.append((doc_id, n, *[None] * 7))
                        continue
                    payload = b"".join(red)
                    colours = np.array([f["histogram"] for f in frames], np.int64).reshape(-1, 3, 16).sum(axis=0)
                    told = ";".join([f"frames={len(frames)}", f"ms={sum(f['delay_ms'] for f in frames)}", *(f"{c}=" + ",".join(map(str, own.tolist())) for c, own in zip(("red", "green", "blue"), colours, strict=True))])
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), frames, told))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return slim.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {FRAME_TYPE}, feature string")


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as GIF files, read back."""
    return read_payloads(store_media(table(spark, sf_dir, "documents"))).drop("frames")
