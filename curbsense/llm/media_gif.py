"""Media columns: GIF files as binary columns, decoded to timed frames with colour histograms.

The decoder reads LZW code streams, interlaced or not, and paints each frame on the canvas with its
palette, transparent index and disposal rule. The encoder stores bytes as timed frames of WIDTH
samples a row, each cleared after it was shown, in the colours of one palette, all different; a
payload is read back from the painted colours, by their red. Every frame gets a histogram of its
visible colours as an array column.

The width of a code follows from its number since the last clear code, so whole runs of codes are
taken out of a stream, and put into it, by array operations; only the dictionary is walked code by
code.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbsense.llm.session import python_batches

#: Samples a row, most rows of a frame, and hundredths of a second a frame is shown.
WIDTH, ROWS, DELAY = 64, 1024, 10
TABLE = 4096
#: Sample i in red, green and blue: red is i itself, so colours tell samples apart.
PALETTE = np.stack([np.arange(256), np.arange(256) * 5 % 256, 255 - np.arange(256)], axis=1).astype(np.uint8)
#: Ranges of a colour in a histogram.
BINS = 4


@dataclass
class Frame:
    left: int
    top: int
    delay_ms: int
    disposal: int
    #: Samples of the frame itself, and the canvas (red, green, blue, alpha) after it was painted.
    samples: np.ndarray
    canvas: np.ndarray


@functools.cache
def _widths(bits: int) -> np.ndarray:
    """Widths of the first TABLE codes after a clear code, for samples of `bits` bits; later ones have 12."""
    known = (1 << bits) + 2 + np.maximum(np.arange(TABLE) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(known)).astype(np.int64) + 1))


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """The LZW codes of samples, with a clear code first and wherever the dictionary is full, and the end code."""
    clear, out = 1 << bits, [1 << bits]
    append, known, following = out.append, {}, clear + 2
    get = known.get
    prefix = -1
    for sample in data:
        if prefix < 0:
            prefix = sample
            continue
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        append(prefix)
        known[key] = following
        following += 1
        prefix = sample
        if following == TABLE:
            append(clear)
            known.clear()
            following = clear + 2
    if prefix >= 0:
        append(prefix)
    append(clear + 1)
    return out


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    values = np.array(codes, dtype=np.int64)
    n = len(values)
    # A clear code has the width of its own place; the codes behind it count anew.
    after = np.zeros(n, dtype=np.int64)
    after[1:] = np.where(values[:-1] == 1 << bits, np.arange(1, n), 0)
    place = np.arange(n) - np.maximum.accumulate(after)
    place[0] = 0
    widths = _widths(bits)[place]
    start = np.cumsum(widths) - widths
    shifted = values << (start & 7)
    out = np.zeros((int(start[-1]) + int(widths[-1]) + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount((start >> 3) + k, weights=(shifted >> (8 * k)) & 255, minlength=len(out))[: len(out)]
    return out[:-3].astype(np.uint8).tobytes()


def unpack_codes(stream: bytes, bits: int) -> Iterator[list[int]]:
    """Runs of codes between clear codes, up to the end code or the end of the stream."""
    data = np.frombuffer(stream + bytes(4), dtype=np.uint8).astype(np.int64)
    clear, at, end = 1 << bits, 0, len(stream) * 8
    step = TABLE
    while at < end:
        run: list[np.ndarray] = []
        widths = _widths(bits)[: (end - at) // (bits + 1) + 1]
        while True:
            start = at + np.cumsum(widths) - widths
            fits = start + widths <= end
            start, w = start[fits], widths[fits]
            byte = start >> 3
            codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7)) & ((1 << w) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                run.append(codes[: stop[0]])
                at = end if codes[stop[0]] == clear + 1 else int(start[stop[0]] + w[stop[0]])
                break
            run.append(codes)
            if len(codes) < len(widths) or len(widths) < step:
                at = end
                break
            at = int(start[-1] + w[-1])
            widths = np.full(step, 12, dtype=np.int64)  # a full dictionary stays as it is until a clear code
        yield np.concatenate(run).tolist()


def lzw_samples(stream: bytes, bits: int) -> bytes:
    clear = 1 << bits
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    append = out.append
    for codes in unpack_codes(stream, bits):
        if not codes:
            continue
        table = single.copy()
        grow = table.append
        before = table[codes[0]]
        append(before)
        for code in codes[1:]:
            n = len(table)
            if code < n:
                entry = table[code]
            elif code == n:
                entry = before + before[:1]
            else:
                raise ValueError("a code is ahead of the dictionary")
            append(entry)
            if n < TABLE:
                grow(before + entry[:1])
            before = entry
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A GIF whose samples are the payload (its length a positive multiple of WIDTH), in frames of at most ROWS rows."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"a payload has a positive multiple of {WIDTH} bytes")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(pack_codes(lzw_codes(part))))
    return b"".join(out) + b"\x3b"


def decode_gif(data: bytes) -> list[Frame]:
    """The frames of a GIF file. A file that breaks the format raises ValueError or IndexError."""
    return [Frame(f.left, f.top, f.delay_ms, f.disposal, f.samples, f.canvas.copy()) for f in decoded(data)]


def decoded(data: bytes) -> Iterator[Frame]:
    """decode_gif() frame by frame; a frame's canvas is painted on by the next one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        size = 3 << ((flags & 7) + 1)
        out = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(-1, 3)
        at += size
        return out

    def blocks() -> bytes:
        nonlocal at
        out = []
        while n := data[at]:
            out.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(out)

    common = palette(flags)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_index = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(flags)
        colours = common if colours is None else colours
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        at += 1
        samples = np.frombuffer(lzw_samples(blocks(), bits), dtype=np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame is short of samples")
        samples = samples[: w * h].reshape(h, w)
        if flags & 0x40:  # interlaced: every 8th row, every 8th from 4, every 4th from 2, every 2nd from 1
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[rows] = samples
            samples = plain
        saved = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = samples[: area.shape[0], : area.shape[1]]
        painted = np.empty((*shown.shape, 4), dtype=np.uint8)
        painted[..., :3] = colours[np.minimum(shown, len(colours) - 1)]
        painted[..., 3] = 255
        if clear_index is None:
            area[:] = painted
        else:
            area[shown != clear_index] = painted[shown != clear_index]
        yield Frame(left, top, delay, disposal, samples, canvas)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = saved
        delay, disposal, clear_index = 0, 0, None


def payload_of(frames: list[Frame]) -> bytes:
    """The bytes that encode_gif() has stored, from the painted canvases."""
    return b"".join(f.canvas[: f.samples.shape[0], :, 0].tobytes() for f in frames)


def histogram(frame: Frame) -> np.ndarray:
    """Visible pixels of a canvas by (red, green, blue), BINS ranges each."""
    colour = frame.canvas.view("<u4")[..., 0]
    low = 8 - BINS.bit_length() + 1
    code = (colour >> low & BINS - 1) * BINS**2 + (colour >> low + 8 & BINS - 1) * BINS + (colour >> low + 16 & BINS - 1)
    return np.bincount(code[colour > 0xFFFFFF], minlength=BINS**3)


def feature_of(histograms: list[np.ndarray], delays: list[int]) -> str:
    """Frames, total time, and the visible pixels of all frames by colour: range of red, green, blue, and count, where there are some."""
    total = np.sum(histograms, axis=0)
    told = [f"{k // BINS**2}{k // BINS % BINS}{k % BINS}:{total[k]}" for k in np.flatnonzero(total)]
    return f"frames={len(histograms)};ms={sum(delays)};colours={','.join(told)}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_bytes and media, its text as a GIF file (UTF-8, filled up with 0 to a multiple of WIDTH).

    A null text counts as empty, so its payload is WIDTH zeros. A text of any length is stored whole,
    in frames of at most WIDTH * ROWS bytes. A null id stays null; repeated rows give equal rows; an
    empty table gives none. Other columns of df are left out and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                texts = [(t or "").encode() for t in batch.column(1)[i : i + 100].to_pylist()]
                media = [encode_gif(t + bytes(-len(t) % WIDTH or WIDTH * (not t))) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 100], pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    python_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """store_texts() rows with digests of the payload that decoding gives, of the file, its feature, and its frames.

    frames has each frame's number, time in milliseconds and colour histogram. Frames are decoded one
    after another, so a long file's canvases aren't held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, histograms, delays, cuts = [], [np.zeros(0, np.int64)], [], [0]
            for media in batch.column(2):
                media = media.as_py()
                payload, first = [], len(histograms)
                for f in decoded(media):
                    payload.append(f.canvas[: f.samples.shape[0], :, 0].tobytes())
                    histograms.append(histogram(f))
                    delays.append(f.delay_ms)
                payload = b"".join(payload)
                cuts.append(len(delays))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(histograms[first:], delays[cuts[-2] :])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(delays) + 1, dtype=np.int32) * BINS**3), pa.array(np.concatenate(histograms)))
            number = np.arange(len(delays)) - np.repeat(cuts[:-1], np.diff(cuts))
            frame = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(delays, pa.int32()), counts], names=["frame", "delay_ms", "histogram"])
            frames = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), frame)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds), frames], names=[id_col, "n_bytes", *NAMES, "frames"])

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<frame:int,delay_ms:int,histogram:array<long>>>"
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` long, n_bytes long, {fields}")


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def frames(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row for each frame of each file: id, frame, delay_ms, width, height and histogram (array<long> of 64 colour ranges).

    A null file has no rows; one that is not a readable GIF has one row with null frame, which tells
    it from a file without frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not media.is_valid:
                    continue
                try:
                    rows = [(key, i, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], histogram(f).tolist()) for i, f in enumerate(decoded(media.as_py()))]
                except (ValueError, IndexError, struct.error):
                    rows = [(key, None, None, None, None, None)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "frame", "delay_ms", "width", "height", "histogram"])

    python_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(media_col).alias("media")).mapInArrow(run, f"`{id_col}` long, frame int, delay_ms int, width int, height int, histogram array<long>")
