"""Media columns: AVI motion-JPEG (operator 5).

A payload is stored as the quantised coefficients of intra-coded JPEG frames in an AVI file.  Every
block has a zero DC coefficient and 63 AC coefficients of category 8, whose eight appended bits are
a byte of the payload; the Huffman tables give the one symbol that occurs a one-bit code.  So a block
is 568 bits, 71 bytes, the stream stays baseline JPEG with quantisation steps of 1, and what is read
back is exact.  A frame is 24 by 24 samples, so most texts have several.

Readers parse the RIFF tree (AVIX parts too) and the ``idx1`` index, whose offsets may count from the
list of frames or from the file's start; without an index the list itself is walked.  The frame decoder
takes any baseline JPEG: its quantisation and Huffman tables (the standard ones where a frame has none,
as motion-JPEG allows), grey or colour with any sampling factors, restart intervals.  Streams of our own
fixed-width codes are decoded by array operations, all frames at once.

Shots: a cut is where the difference of successive luma histograms exceeds the mean of the differences
before it in the shot by a factor, and a floor.  ``clips`` yields a timed row for each shot, and one row
with the reason for media that can't be decoded.

Defined results: a null text is the empty text and is stored as 64 zero bytes; texts of any length
are stored whole, one frame for each 567 bytes; equal texts give equal media, hence equal rows; an
empty table gives an empty result; null or broken media gives one row without a clip and with a reason.
A binary value of Spark ends at 2 GiB, so files stay below the 4 GiB of RIFF; a text whose file would
be larger is an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import store, words

SIDE, PER_BLOCK = 3, 63  # blocks of a frame's side; payload bytes of a block
PER_FRAME, BLOCK_BYTES, RATE = SIDE * SIDE * PER_BLOCK, 71, 25
#: frames that are decoded or counted together
TOGETHER = 2048
# Fixed values of the JPEG standard: the order in which a block's coefficients are sent.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(symbol: int) -> bytes:
    return bytes([1] + [0] * 15 + [symbol])


_HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + _one_code(0)) + _segment(0xC4, b"\x10" + _one_code(8)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames whose coefficients are the payload, filled up with zero bytes."""
    n = -(-len(payload) // PER_FRAME)
    data = np.zeros(n * PER_FRAME, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    bits = np.zeros((n * SIDE * SIDE, 568), np.uint8)
    bits[:, 1:].reshape(-1, PER_BLOCK, 9)[:, :, 1:] = np.unpackbits(data).reshape(-1, PER_BLOCK, 8)
    packed = np.packbits(bits.reshape(-1)).reshape(n, -1)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]


def _codes(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of a Huffman table."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _standard(counts: str, first: str) -> dict[tuple[int, int], int]:
    """A table from the numbers of its codes by length and its first symbols; for AC tables all others follow in order."""
    symbols = bytes.fromhex(first)
    if len(symbols) > 12:
        symbols += bytes(sorted({0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))} - set(symbols)))
    return _codes(bytes.fromhex(counts) + symbols)


# Fixed values of the JPEG standard: the tables that a motion-JPEG frame without tables of its own uses.
STANDARD = {
    0x00: _standard("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: _standard("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: _standard("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: _standard("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


class Frame(NamedTuple):
    """The luma of a frame: coefficients (blocks, 64) in zigzag order before dequantisation, row by row of blocks."""

    coefficients: np.ndarray
    steps: np.ndarray
    width: int
    height: int

    def luma(self) -> np.ndarray:
        """Samples (height, width)."""
        across = -(-self.width // 8)
        samples = np.clip(np.rint((self.coefficients.astype(np.float32) * self.steps) @ INVERSE) + 128, 0, 255).astype(np.uint8)
        return samples.reshape(-1, across, 8, 8).swapaxes(1, 2).reshape(-1, 8 * across)[: self.height, : self.width]


def decode_frame(jpeg: bytes) -> Frame:
    """The luma of a baseline frame."""
    at, tables, steps, restart, parts = 2, dict(STANDARD), {}, 0, []
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        while jpeg[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body, at = jpeg[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + size :]
        elif marker == 0xC0 or marker == 0xC1:
            bits, height, width = struct.unpack(">BHH", body[:5])
            if bits != 8:
                raise ValueError(f"{bits} bits a sample are not decoded")
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif marker == 0xC4:
            while body:
                used = 17 + sum(body[1:17])
                tables[body[0]] = _codes(body[1:used])
                body = body[used:]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            coders = {body[k]: (tables[body[k + 1] >> 4], tables[0x10 | body[k + 1] & 15]) for k in range(1, 1 + 2 * body[0], 2)}
            break
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
    if not parts or len(coders) != len(parts) or parts[0][3] not in steps:
        raise ValueError("a frame without its tables, or of several scans")
    scan = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    if len(parts) == 1:  # a lone component is not interleaved
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    h_most, v_most = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * h_most)), -(-height // (8 * v_most))
    layout = [(k, *coders[c]) for k, (c, h, v, _) in enumerate(parts) for _ in range(h * v)]
    own = _decode_scan(scan, across * down, layout, restart)
    _, h, v, q = parts[0]
    # blocks of an interleaved unit to rows of blocks
    rows = own.reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * v, across * h, 64)
    width, height = -(-width * h // h_most), -(-height * v // v_most)
    return Frame(rows[: -(-height // 8), : -(-width // 8)].reshape(-1, 64), steps[q], width, height)


def _decode_scan(scan: bytes, units: int, layout: list[tuple[int, dict, dict]], restart: int) -> np.ndarray:
    """Coefficients of the first component; layout: (component, DC table, AC table) of each block of a unit."""
    per = sum(k == 0 for k, _, _ in layout)
    out, done, n_out = np.zeros((units * per, 64), np.int16), 0, 0
    for part in re.split(b"\xff[\xd0-\xd7]", scan) if restart else [scan]:
        bits, at = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0
        last = dict.fromkeys((k for k, _, _ in layout), 0)

        def value(n: int) -> int:
            nonlocal at
            x = 0
            for b in bits[at : at + n]:
                x = x << 1 | b
            at += n
            return x if not n or x >> n - 1 else x - (1 << n) + 1

        def symbol(table: dict) -> int:
            nonlocal at
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("a code that no table has")

        for _ in range(min(restart or units, units - done)):
            for component, dc, ac in layout:
                last[component] += value(symbol(dc))
                row = out[n_out] if component == 0 else np.empty(64, np.int16)
                row[0], j = last[component], 1
                while j < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    j += s >> 4
                    if s & 15:
                        row[j] = value(s & 15)
                    j += 1
                n_out += component == 0
            done += 1
    return out


def _own_coefficients(frames: list[bytes]) -> np.ndarray | None:
    """(frames, blocks, 64) of frames as :func:`encode_frames` writes them, None for others."""
    if not all(f.startswith(_HEAD) for f in frames):
        return None
    scans = [f[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
    if any(len(x) != SIDE * SIDE * BLOCK_BYTES for x in scans):
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(scans), np.uint8)).reshape(-1, 568)
    raw = np.packbits(bits[:, 1:].reshape(-1, PER_BLOCK, 9)[:, :, 1:].reshape(-1)).reshape(len(frames), -1, PER_BLOCK).astype(np.int16)
    out = np.zeros((*raw.shape[:2], 64), np.int16)
    out[:, :, 1:] = np.where(raw < 128, raw - 255, raw)
    return out


def decode_frames(frames: list[bytes]) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """(coefficients of our own frames or None, luma histograms) of each run of frames."""
    for k in range(0, len(frames), TOGETHER):
        part = frames[k : k + TOGETHER]
        own = _own_coefficients(part)
        if own is None:
            yield None, np.stack([luma_histogram(decode_frame(f).luma()) for f in part])
        else:
            luma = np.clip(np.rint(own.astype(np.float32) @ INVERSE) + 128, 0, 255).astype(np.int64) >> 4
            place = luma.reshape(len(part), -1) + 16 * np.arange(len(part))[:, None]
            yield own, np.bincount(place.ravel(), minlength=16 * len(part)).reshape(-1, 16) / luma[0].size


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """An AVI file of one motion-JPEG stream; the JUNK chunk of its header has the number of payload bytes."""
    side, biggest = 8 * SIDE, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, biggest * RATE, 0, 0x10, len(frames), 0, 1, biggest, side, side, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, side, side)
    form = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)) + _chunk(b"JUNK", struct.pack("<Q", n_bytes)))
    movie, index = [b"movi"], []
    at = 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    if sum(map(len, movie)) >= 1 << 31:
        raise ValueError("a file of 2 GiB or more fits no binary value")
    body = b"AVI " + headers + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes | None) -> tuple[float, int, list[bytes]]:
    """(seconds a frame, payload bytes or -1, frames by the index) of an AVI file."""
    if data is None or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, list[tuple[int, int]]] = {}
    listed: list[tuple[int, int]] = []

    def walk(at: int, end: int, frames: bool = False) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name in (b"LIST", b"RIFF"):
                kind = data[at + 8 : at + 12]
                found.setdefault(kind, []).append((at + 8, size))
                walk(at + 12, min(end, at + 8 + size), frames or kind == b"movi")
            elif frames and name[2:] in (b"dc", b"db"):
                listed.append((at, size))
            found.setdefault(name, []).append((at + 8, size))
            at += 8 + size + (size & 1)

    walk(0, len(data))
    main, movie = found[b"avih"][0][0], found[b"movi"][0][0]
    frames = []
    if b"idx1" in found and len(found[b"movi"]) == 1:
        index, size = found[b"idx1"][0]
        entries = [struct.unpack("<4sIII", data[k : k + 16]) for k in range(index, index + size - 15, 16)]
        entries = [(name, at, length) for name, _, at, length in entries if name[2:] in (b"dc", b"db")]
        # offsets count from the list's name, or from the start of the file
        base = next((b for b in (movie, 0) if entries and data[b + entries[0][1] : b + entries[0][1] + 4] == entries[0][0]), None)
        if entries and base is None:
            raise ValueError("an index that leads to no frame")
        frames = [data[base + at + 8 : base + at + 8 + length] for _, at, length in entries]
    else:  # no index, or parts that idx1 does not cover: the lists themselves
        frames = [data[at + 8 : at + 8 + size] for at, size in listed]
    junk = found.get(b"JUNK")
    n = int.from_bytes(data[junk[0][0] : junk[0][0] + 8], "little") if junk and junk[0][1] == 8 else -1
    return int.from_bytes(data[main : main + 4], "little") / 1e6, n, frames


def payload_of(coefficients: list[np.ndarray], n_bytes: int) -> bytes:
    raw = np.concatenate([c.reshape(-1, 64) for c in coefficients])[:, 1:].reshape(-1)
    return np.where(raw < 0, raw + 255, raw).astype(np.uint8).tobytes()[:n_bytes]


_COSINE = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: zigzag coefficients to the 64 samples of a block
INVERSE = np.stack([np.outer(_COSINE[z // 8], _COSINE[z % 8]).reshape(-1) for z in ZIGZAG]).astype(np.float32)


def luma_histogram(luma: np.ndarray) -> np.ndarray:
    """Shares of 16 luma bins."""
    return np.bincount((luma >> 4).reshape(-1), minlength=16) / luma.size


def shots(histograms: list[np.ndarray], factor: float = 3.0, floor: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot; the threshold follows the differences seen in the shot."""
    cuts, seen = [0], []
    for k in range(1, len(histograms)):
        d = float(np.abs(histograms[k] - histograms[k - 1]).sum()) / 2
        if d > max(floor, factor * (sum(seen) / len(seen) if seen else 0.0)):
            cuts.append(k)
            seen = []
        else:
            seen.append(d)
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(histograms)], strict=True)]


def store_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each whole text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 2 << 20):
            texts = [(x or "").encode() for x in batch["text"].to_pylist()]
            media = [write_avi(encode_frames(t + b"\x00" * (max(64, -(-len(t) // 64) * 64) - len(t))), max(64, -(-len(t) // 64) * 64)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, n_bytes long, media binary")


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each shot: key, clip, start_s, seconds, frames, and a null error. Media that can't be decoded has
    one row, with the reason as its error and nulls for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "media", 2 << 20):
            out: list[tuple] = []
            for k, data in zip(batch["key"].to_pylist(), batch["media"].to_pylist(), strict=True):
                try:
                    seconds, _, frames = read_avi(data)
                    found = shots([h for _, part in decode_frames(frames) for h in part])
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    out.append((k, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                out += [(k, n, a * seconds, length * seconds, length, None) for n, (a, length) in enumerate(found)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch["key"].type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()), strict=True)], [key, "clip", "start_s", "seconds", "frames", "error"])

    rows = media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("media"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, clip int, start_s double, seconds double, frames int, error string")


def _told(data: bytes | None) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error of one file."""
    if data is None:
        return None, None, None, None, None, None, "ValueError: media is null"
    own, middle = (len(data), hashlib.sha256(data).hexdigest()), np.arange(16) * 16 + 8
    try:
        seconds, n, frames = read_avi(data)
        decoded, seen = zip(*decode_frames(frames), strict=True)
        luma = np.concatenate(seen)
        feature = ";".join(f"{a * seconds:.2f}+{length * seconds:.2f}:{luma[a : a + length].mean(0) @ middle:.1f}" for a, length in shots(list(luma)))
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, *own, None, f"{type(e).__name__}: {e}"
    if n < 0 or any(c is None for c in decoded):
        return None, None, None, *own, feature, "ValueError: the frames hold no payload"
    payload = payload_of(decoded, n)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, feature, None


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: payload digests, media digests, and the shots: start, length and mean luma of each.

    Media of others has features and no payload; what is null or can't be decoded has nulls; ``error`` tells why.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "media", 2 << 20):
            columns = list(zip(*map(_told, batch["media"].to_pylist()), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    rows = media.select(F.col(f"`{key}`").alias("key"), "n_bytes", "media")
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as AVI motion-JPEG, read back, with its shots."""
    return media_features(store_as_media(store.table(spark, sf_dir, "documents")))
