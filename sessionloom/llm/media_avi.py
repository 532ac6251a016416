"""AVI motion-JPEG columns: RIFF index parsing, intra-frame decoding and shot detection.

Frames are JPEG pictures of their own (no prediction between frames). Two JPEG processes are read: baseline DCT
(SOF0, grey or YCbCr, any sampling) and lossless Huffman coding (SOF3, predictor 1, one restart interval a line).
The writer makes the lossless kind, so 8-bit samples come back bit for bit; because every line is a restart
interval, the reader decodes all lines of all frames of a batch in lockstep, one column of samples a step.

Shots: consecutive frames are compared by the L1 distance of their normalised grey histograms; a cut is where the
distance exceeds an adaptive threshold, the mean plus ``SIGMAS`` deviations of the distances seen in the current
shot (never under ``FLOOR``). Each shot becomes a timed clip.

Edge cases: null or empty media has no frames and no clips; a file without a usable ``idx1`` is read by walking
``movi``; a truncated last chunk is left out; a frame that isn't readable JPEG raises ValueError in ``read_avi`` and is
an ``error`` text in ``clip_rows``. Repeated rows give repeated results. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio

WIDTH, HEIGHT, RATE = 64, 64, 25
BINS, SIGMAS, FLOOR, WARMUP = 32, 3.0, 0.25, 3
#: Code lengths by difference category 0..8; the sum of 2^-length stays under one, so no code is all ones.
CODE_BITS = (4, 5, 4, 4, 3, 3, 2, 2, 6)


def _huffman(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), canonical as DHT describes it."""
    code, last, out = 0, 0, {}
    for symbol, bits in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= bits - last
        out[symbol], last = (code, bits), bits
        code += 1
    return out


_CODES = _huffman(dict(enumerate(CODE_BITS)))
_PEEK = max(CODE_BITS)


def _difference_tables() -> tuple[np.ndarray, np.ndarray]:
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = _CODES[n]
        value[d + 255], bits[d + 255] = code << n | (d if d >= 0 else d - 1) & (1 << n) - 1, length + n
    return value, bits


_VALUE, _BITS = _difference_tables()
_CATEGORY, _LENGTH = np.zeros(1 << _PEEK, np.int32), np.zeros(1 << _PEEK, np.int32)
for _s, (_c, _b) in _CODES.items():
    _CATEGORY[_c << _PEEK - _b : _c + 1 << _PEEK - _b], _LENGTH[_c << _PEEK - _b : _c + 1 << _PEEK - _b] = _s, _b


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(lines: int, width: int) -> bytes:
    counts = bytes(sum(b == n for b in CODE_BITS) for n in range(1, 17))
    symbols = bytes(sorted(range(len(CODE_BITS)), key=lambda s: (CODE_BITS[s], s)))
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + counts + symbols)
        + _segment(0xDD, struct.pack(">H", width))
        + _segment(0xC3, struct.pack(">BHHB", 8, lines, width, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


def _coded_lines(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each line (stuffed), one after the other, and where each line starts (n + 1 offsets)."""
    left = np.empty(samples.shape, np.int16)
    left[:, 0], left[:, 1:] = 128, samples[:, :-1]
    index = samples.astype(np.int16) - left + 255
    bits = _BITS[index].astype(np.int64)
    at = np.cumsum(bits, axis=1)
    size = at[:, -1] + 7 >> 3
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=base[1:])
    at += (base[:-1] * 8)[:, None]
    value = _VALUE[index]
    # the unused bits of a line's last byte are ones
    pad = (base[1:] * 8 - at[:, -1]).astype(np.uint8)
    at -= bits
    shifted = (value << (24 - (at & 7) - bits).astype(np.uint32)).ravel()
    at = (at >> 3).ravel()
    out = np.zeros(int(base[-1]) + 2, np.int64)
    for k in range(3):
        out[: len(out) - 2 + k] += np.bincount(at + k, (shifted >> np.uint32(16 - 8 * k) & 255), minlength=len(out))[: len(out) - 2 + k].astype(np.int64)
    data = out[:-2].astype(np.uint8)
    data[base[1:] - 1] |= (1 << pad).astype(np.uint8) - np.uint8(1)
    # a zero byte follows each 0xFF
    full = data == 255
    if full.any():
        where = np.arange(len(data)) + np.concatenate(([0], np.cumsum(full)[:-1]))
        stuffed = np.zeros(len(data) + int(full.sum()), np.uint8)
        stuffed[where] = data
        before = np.concatenate(([0], np.cumsum(full)))
        return stuffed, base + before[base]
    return data, base


def encode_frames(payloads: list[bytes], width: int = WIDTH, height: int = HEIGHT) -> list[list[bytes]]:
    """Lossless JPEG frames of each payload (its length a positive multiple of ``width``), ``height`` lines a frame at most."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    data, at = _coded_lines(samples)
    blob, line, heads, out = data.tobytes(), 0, {}, []
    at = at.tolist()
    for payload in payloads:
        frames, left = [], len(payload) // width
        while left:
            n = min(left, height)
            parts = [heads.setdefault(n, _jpeg_head(n, width))]
            for k in range(n):
                parts.append(blob[at[line + k] : at[line + k + 1]])
                parts.append(bytes((0xFF, 0xD0 + k % 8)) if k < n - 1 else b"\xff\xd9")
            frames.append(b"".join(parts))
            line, left = line + n, left - n
        out.append(frames)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file with one video stream of the JPEG frames and an ``idx1`` index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(piece := _chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(piece)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes | None) -> dict:
    """{"rate": frames a second, "width", "height", "frames": [JPEG bytes, ...]} from the index, or from ``movi`` without one."""
    out: dict = {"rate": float(RATE), "width": 0, "height": 0, "frames": []}
    if not data:
        return out
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index = None, b""
    for name, at, size in _walk(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for sub, pos, n in _walk(data, at + 4, at + size):
                if sub == b"avih" and n >= 40:
                    out["width"], out["height"] = struct.unpack_from("<II", data, pos + 32)
                elif sub == b"LIST":
                    for leaf, place, m in _walk(data, pos + 4, pos + n):
                        if leaf == b"strh" and data[place : place + 4] == b"vids" and m >= 28:
                            scale, rate = struct.unpack_from("<II", data, place + 20)
                            out["rate"] = rate / scale if scale and rate else float(RATE)
        elif name == b"LIST" and kind == b"movi":
            movi = (at, min(at + size, len(data)))
        elif name == b"idx1":
            index = data[at : at + size]
    if movi is None:
        return out
    entries = list(struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]))
    entries = [(p, n) for name, _, p, n in entries if name[2:] in (b"dc", b"db")]
    # offsets count from the list's type or, in some files, from the start of the file
    shift = next((s for s in (movi[0], 0) if entries and data[s + entries[0][0] :][2:4] in (b"dc", b"db")), None)
    if shift is None:
        found = [(at, n) for name, at, n in _walk(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    else:
        found = [(shift + p + 8, n) for p, n in entries]
    out["frames"] = [data[at : at + n] for at, n in found if at + n <= len(data) and n]
    return out


def _markers(frame: bytes) -> dict:
    """Header fields of one JPEG frame; ``scan`` is where the entropy-coded data starts."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    head: dict = {"tables": {}, "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                lengths = [b for b, c in enumerate(counts, 1) for _ in range(c)]
                head["tables"][body[0]] = (tuple(lengths), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                head["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif kind == 0xDD:
            head["restart"] = int.from_bytes(body[:2], "big")
        elif kind in (0xC0, 0xC1, 0xC3):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are read")
            head |= {"kind": kind, "height": height, "width": width, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {kind:#x} isn't read")
        elif kind == 0xDA:
            if "kind" not in head:
                raise ValueError("scan before frame header")
            head["scan_tables"] = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            head["predictor"], head["scan"] = body[1 + 2 * body[0]], at
            return head
    raise ValueError("no scan")


def _lockstep(scans: list[bytes], width: int) -> np.ndarray:
    """Samples, (lines, width), of the scans of lossless frames whose lines are restart intervals, coded by CODE_BITS."""
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0\0", np.uint8)
    after = np.flatnonzero(raw[:-1] == 255)
    marker = raw[after + 1]
    cut = after[(marker >= 0xD0) & (marker <= 0xD9)]
    keep = np.ones(len(raw), bool)
    keep[after[marker == 0] + 1] = False
    shift = np.cumsum(~keep)
    start = np.concatenate(([0], cut[:-1] + 2))
    data = raw[keep].astype(np.int32)
    at = (start - shift[start]).astype(np.int64) * 8
    # three bytes from each place on as one number: a step gathers once
    three = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    three = np.concatenate((three, np.zeros(3, np.int32)))
    top = len(three) - 1
    out = np.empty((width, len(at)), np.int32)
    last = np.full(len(at), 128, np.int32)
    for k in range(width):
        window = three[np.minimum(at >> 3, top)] << (at & 7).astype(np.int32) & 0xFFFFFF
        code = window >> 24 - _PEEK
        n, length = _CATEGORY[code], _LENGTH[code]
        extra = (window << length & 0xFFFFFF) >> 24 - n
        low = n > 0
        last = last + np.where(low & (extra >> np.maximum(n - 1, 0) == 0), extra - (1 << n) + 1, extra)
        out[k] = last
        at += length + n
    return (out & 255).astype(np.uint8).T


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.hold = self.hold << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        value = self.hold >> self.n & (1 << n) - 1
        self.hold &= (1 << self.n) - 1
        return value

    def symbol(self, table: dict) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (bits, code) in table:
                return table[bits, code]
        raise ValueError("bad Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def _table(lengths: tuple, symbols: tuple) -> dict:
    code, last, out = 0, 0, {}
    for bits, symbol in zip(lengths, symbols, strict=True):
        code <<= bits - last
        out[bits, code], last = symbol, bits
        code += 1
    return out


def _zigzag() -> np.ndarray:
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in order])


_ZIGZAG = _zigzag()
_DCT = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _plain(frame: bytes, head: dict) -> np.ndarray:
    """Grey samples of any frame of the two processes, symbol by symbol."""
    body = frame[head["scan"] :]
    intervals, at, start = [], 0, 0
    while (at := body.find(b"\xff", at)) >= 0 and at + 1 < len(body):
        if 0xD0 <= body[at + 1] <= 0xD9:
            intervals.append(body[start:at].replace(b"\xff\x00", b"\xff"))
            start = at + 2
            if body[at + 1] > 0xD7:
                break
        at += 2
    else:
        intervals.append(body[start:].replace(b"\xff\x00", b"\xff"))
    tables = {k: _table(*v) for k, v in head["tables"].items()}
    height, width, parts = head["height"], head["width"], head["parts"]
    if head["kind"] == 0xC3:
        if len(parts) > 1 or head["predictor"] != 1:
            raise ValueError("of lossless frames only one component with predictor 1 is read")
        table = tables[head["scan_tables"][parts[0][0]] >> 4]
        out, bits, k = np.zeros((height, width), np.uint8), _Bits(intervals[0]), 0
        per = head["restart"] // width if head["restart"] else height
        for y in range(height):
            if y and y % per == 0:
                k += 1
                bits = _Bits(intervals[k])
            value = 128 if y % per == 0 else int(out[y - 1, 0])
            for x in range(width):
                value = value + bits.signed(bits.symbol(table)) & 255
                out[y, x] = value
        return out
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        hmax = vmax = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    cols, rows = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    grey = np.zeros((rows * parts[0][2] * 8, cols * parts[0][1] * 8))
    bits, k, dc = _Bits(intervals[0]), 0, [0] * len(parts)
    for unit in range(rows * cols):
        if head["restart"] and unit and unit % head["restart"] == 0:
            k += 1
            bits, dc = _Bits(intervals[k]), [0] * len(parts)
        for c, (name, h, v, q) in enumerate(parts):
            which = head["scan_tables"][name]
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    dc[c] += bits.signed(bits.symbol(tables[which >> 4]))
                    block[0], i = dc[c], 1
                    while i < 64:
                        s = bits.symbol(tables[0x10 | which & 15])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[_ZIGZAG[min(i, 63)]] = bits.signed(s & 15) * head["quant"][q][min(i, 63)]
                        i += 1
                    if c == 0:
                        block[0] *= head["quant"][q][0]
                        top, side = (unit // cols * v + y) * 8, (unit % cols * h + x) * 8
                        grey[top : top + 8, side : side + 8] = _DCT.T @ block.reshape(8, 8) @ _DCT
    return np.clip(np.rint(grey[:height, :width] + 128), 0, 255).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Grey samples of each JPEG frame; lossless frames of our own layout are decoded together."""
    heads = [_markers(f) for f in frames]
    own = (tuple(sorted(CODE_BITS)), tuple(sorted(range(len(CODE_BITS)), key=lambda s: (CODE_BITS[s], s))))
    fast: dict[int, list[int]] = {}
    out: list = [None] * len(frames)
    for k, h in enumerate(heads):
        if h["kind"] == 0xC3 and h["predictor"] == 1 and h["restart"] == h["width"] and h["tables"].get(0) == own and frames[k].endswith(b"\xff\xd9"):
            fast.setdefault(h["width"], []).append(k)
        else:
            out[k] = _plain(frames[k], h)
    for width, which in fast.items():
        lines = _lockstep([frames[k][heads[k]["scan"] :] for k in which], width)
        at = 0
        for k in which:
            out[k] = lines[at : at + heads[k]["height"]]
            at += heads[k]["height"]
    return out


def histogram(frame: np.ndarray) -> np.ndarray:
    return np.bincount(frame.ravel() >> 3, minlength=BINS) / max(frame.size, 1)


def cuts(histograms: list[np.ndarray]) -> list[int]:
    """Frames that start a shot, 0 first."""
    found, seen = [0] if histograms else [], []
    for k in range(1, len(histograms)):
        d = float(np.abs(histograms[k] - histograms[k - 1]).sum())
        if d > max(FLOOR, (np.mean(seen) + SIGMAS * np.std(seen)) if len(seen) >= WARMUP else 0.0):
            found.append(k)
            seen = []
        else:
            seen.append(d)
    return found


def clips(frames: list[np.ndarray], rate: float) -> list[tuple[int, int, float, float]]:
    """(first frame, frame after the last, start seconds, end seconds) of each shot."""
    if not frames:
        return []
    starts = cuts([histogram(f) for f in frames])
    return [(a, b, a / rate, b / rate) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def read_avi(data: bytes | None) -> tuple[list[np.ndarray], float]:
    parsed = parse_avi(data)
    return decode_frames(parsed["frames"]), parsed["rate"]


def clip_rows(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each timed clip of each AVI value: id, clip, first_frame, end_frame, start_s, end_s, error.

    Null or empty media gives no row; media that can't be read gives one row with ``error`` and nulls.
    """
    schema = "id long, clip int, first_frame int, end_frame int, start_s double, end_s double, error string"

    @arrowio.lean
    def run(batches):
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(key, k, *c, None) for k, c in enumerate(clips(*read_avi(data.as_py())))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((key, None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "clip", "first_frame", "end_frame", "start_s", "end_s", "error"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def _digest(ids: list, texts: list[bytes | None]) -> list:
    raw = [t or b"" for t in texts]
    padded = [t + b"\0" * (-len(t) % 64 if t else 64) for t in raw]
    media = [write_avi(frames) for frames in encode_frames(padded)]
    parsed = [parse_avi(m) for m in media]
    decoded = decode_frames([f for p in parsed for f in p["frames"]])
    out, at = [], 0
    for key, text, stored, info in zip(ids, raw, media, parsed, strict=True):
        frames = decoded[at : at + len(info["frames"])]
        at += len(frames)
        payload = b"".join(f.tobytes() for f in frames)
        found = clips(frames, info["rate"])
        feature = f"frames={len(frames)};clips=" + ",".join(f"{a / info['rate']:.2f}-{b / info['rate']:.2f}" for a, b, *_ in found)
        out.append((key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(found)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_shots long"


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text's bytes (padded with zeros to a positive multiple of 64) as AVI, reads them back and describes them."""
    return arrowio.map_chunks(arrowio.id_text(docs), _digest, DIGEST_SCHEMA)


def op1_avi_shots(spark, sf_dir: str) -> DataFrame:
    return text_media_digest(arrowio.documents(spark, sf_dir))
