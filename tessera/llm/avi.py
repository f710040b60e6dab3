"""Media columns as AVI motion-JPEG.

A payload becomes a greyscale film, ``WIDTH`` samples a line and ``LINES`` lines a frame,
whose last frame has fewer lines. Each frame is a JPEG of its own (process 14, lossless,
predictor 1), so decoding gives every 8-bit sample back. The Huffman table gives category
s a code of 9 - s bits; as s further bits follow, every sample takes nine bits and a frame
is decoded by table look-up. Frames with another table are decoded bit by bit.

The reader goes by the RIFF chunks and the index, decodes frames and cuts the film into
shots: a cut is where the histograms of two frames differ by more than the mean of the
differences before it in its shot by ``SPREAD`` deviations, and by ``LEAST`` at any rate.

Null text counts as empty, which is stored as 64 zero bytes; equal texts give equal bytes;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import slices, texts_of

WIDTH, LINES, RATE, UNIT = 64, 64, 25, 64
BINS, SPREAD, LEAST = 16, 3.0, 0.1


def _codes() -> np.ndarray:
    """The nine-bit word of each difference from -255 to 255."""
    words = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        words[d + 255] = ((1 << (8 - s)) - 1) << (s + 1) | (d if d >= 0 else d + (1 << s) - 1)
    return words


WORDS = _codes()
DIFFERENCES = np.zeros(512, np.int16)
DIFFERENCES[WORDS] = np.arange(-255, 256)
LENGTHS, SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded data of all frames of (lines, WIDTH) samples."""
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, 1:] -= x[:, :-1]
    d[1:, 0] -= x[:-1, 0]
    d[::LINES, 0] = x[::LINES, 0] - 128
    w = WORDS[d.reshape(-1, 8) + 255]
    out = np.empty((len(w), 9), np.uint8)
    out[:, 0] = w[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (w[:, k - 1] & ((1 << k) - 1)) << (8 - k) | w[:, k] >> (k + 1)
    out[:, 8] = w[:, 7] & 255
    data, size = out.tobytes(), LINES * WIDTH * 9 // 8
    return [data[i : i + size].replace(b"\xff", b"\xff\0") for i in range(0, len(data), size)]


def jpeg(scan: bytes, lines: int) -> bytes:
    head = _segment(0xC4, b"\0" + LENGTHS + SYMBOLS) + _segment(0xC3, struct.pack(">BHHBBBB", 8, lines, WIDTH, 1, 1, 0x11, 0))
    return b"\xff\xd8" + head + _segment(0xDA, b"\1\1\0\1\0\0") + scan + b"\xff\xd9"


def write_avi(payload: bytes) -> bytes:
    """``payload``, a positive multiple of UNIT bytes, as an AVI file."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    movi, index = [b"movi"], []
    at = 4
    for i, scan in enumerate(encode_scans(samples)):
        frame = jpeg(scan, min(LINES, len(samples) - i * LINES))
        movi.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    n, most = len(index), max(len(x) for x in movi[1:])
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, WIDTH, LINES, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, LINES)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, LINES, 1, 8, b"MJPG", WIDTH * LINES, 0, 0, 256, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, end) of the chunks of a list; a broken size ends at the list's end."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield bytes(data[at : at + 4]), at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def read_index(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames that the index names."""
    view = memoryview(data)
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, base, entries = 1.0, 0, []
    for tag, start, end in chunks(view, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if tag == b"LIST" and view[start : start + 4] == b"hdrl":
            for inner, s, e in chunks(view, start + 4, end):
                if inner == b"LIST":
                    for leaf, s2, _ in chunks(view, s + 4, e):
                        if leaf == b"strh":
                            scale, per = struct.unpack_from("<II", data, s2 + 20)
                            rate = per / max(1, scale)
        elif tag == b"LIST" and view[start : start + 4] == b"movi":
            base = start
        elif tag == b"idx1":
            entries = [struct.unpack_from("<4sIII", data, p) for p in range(start, end - 15, 16)]
    return rate, [bytes(view[base + at + 8 : base + at + 8 + size]) for tag, _, at, size in entries if tag == b"00dc"]


def decode_frame(frame: bytes) -> np.ndarray:
    """The samples of a lossless JPEG of one 8-bit component and predictor 1."""
    at, lines, width, lengths, symbols = 2, 0, 0, LENGTHS, SYMBOLS
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if marker == 0xC4:
            lengths = frame[at + 5 : at + 21]
            symbols = frame[at + 21 : at + 2 + size]
        elif marker == 0xC3:
            lines, width = struct.unpack_from(">HH", frame, at + 5)
        elif marker == 0xDA:
            break
        at += 2 + size
    scan = frame[at + 2 + size : -2].replace(b"\xff\0", b"\xff")
    if (lengths, symbols) == (LENGTHS, SYMBOLS) and lines * width % 8 == 0:
        b = np.frombuffer(scan, np.uint8, lines * width * 9 // 8).reshape(-1, 9).astype(np.uint16)
        w = np.empty((len(b), 8), np.uint16)
        for k in range(8):
            w[:, k] = (b[:, k] & ((1 << (8 - k)) - 1)) << (k + 1) | b[:, k + 1] >> (7 - k)
        d = DIFFERENCES[w].reshape(lines, width).astype(np.int64)
    else:
        d = _decode_bits(scan, lengths, symbols, lines * width).reshape(lines, width)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 255).astype(np.uint8)


def _decode_bits(scan: bytes, lengths: bytes, symbols: bytes, count: int) -> np.ndarray:
    codes, code, k = {}, 0, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            codes[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits, at, out = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, np.zeros(count, np.int64)
    for i in range(count):
        n = code = 0
        while (n, code) not in codes:
            code, n, at = code << 1 | bits[at], n + 1, at + 1
        if s := codes[n, code]:
            value = int("".join(map(str, bits[at : at + s])), 2)
            out[i], at = value if value >> (s - 1) else value - (1 << s) + 1, at + s
    return out


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    hist = [np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames]
    out, first, seen = [], 0, []
    for i in range(1, len(hist)):
        diff = float(np.abs(hist[i] - hist[i - 1]).sum() / 2)
        if diff > LEAST and (not seen or diff > np.mean(seen) + SPREAD * np.std(seen)):
            out.append((first, i - 1))
            first, seen = i, []
        else:
            seen.append(diff)
    return [*out, (first, len(hist) - 1)]


def text_films(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, n_bytes, media (the file), payload (read back from it) and clips (number, frames, seconds)."""
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, films, payloads, clips = [], [], [], []
            for text in texts_of(batch, "text"):
                data = (text or "").encode()
                sizes.append(len(data))
                films.append(write_avi(data + b"\0" * (-len(data) % UNIT if data else UNIT)))
                rate, stored = read_index(films[-1])
                frames = [decode_frame(f) for f in stored]
                payloads.append(b"".join(f.tobytes() for f in frames))
                clips.append([(i, a, b, a / rate, (b + 1) / rate) for i, (a, b) in enumerate(shots(frames))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(films, pa.binary()), pa.array(payloads, pa.binary()), pa.array(clips, clip)], names=["id", "n_bytes", "media", "payload", "clips"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = f"id {kind}, n_bytes long, media binary, payload binary, clips array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double>>"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def clip_rows(films: DataFrame, id_col: str) -> DataFrame:
    """One row a shot, with its times."""
    return films.select(id_col, F.inline("clips"))


def film_digests(films: DataFrame, id_col: str) -> DataFrame:
    size = F.octet_length("payload").cast("long")
    tail = F.crc32(F.substring("payload", -64, 64))
    feature = F.concat_ws(",", F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"].cast("string"), c["last_frame"].cast("string"))))
    return films.select(id_col, "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
