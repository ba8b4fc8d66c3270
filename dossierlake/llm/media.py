"""Media columns in FLAC: texts or other bytes as 8-bit samples, stored losslessly and read back.

Encoding and decoding run over many frames side by side: a step handles the same sample of every frame.
Frames hold a quantised linear predictor and Rice-coded residuals, a CRC-8 over the header and a CRC-16
over the frame; a seek table names every frame's first sample and place, so that a reader can start at
any block.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.bpe import batches_of

BLOCK = 1024  # samples of a frame
RATE = 8000
LANES = 1024  # frames coded side by side
PRECISION, SHIFT = 9, 6  # bits and scale of predictor coefficients
_ORDERS = ((), (1,), (2, -1))  # the fixed predictors, as coefficients


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.uint8)  # leading zeros of 16 bits


def _crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of ``data`` at once."""
    order = np.argsort(-size, kind="stable")
    st, sz = start[order], size[order]
    crc = np.zeros(len(st), np.uint16)
    live = np.searchsorted(-sz, -np.arange(int(sz[0]) if len(sz) else 0), side="left")  # frames longer than i
    for i, m in enumerate(live.tolist()):
        c = crc[:m]
        crc[:m] = (c << 8) ^ _CRC16[(c >> 8) ^ data[st[:m] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the UTF-8 like form, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


@functools.lru_cache(maxsize=1 << 16)
def _frame_header(number: int, size: int) -> bytes:
    code, extra = (10, b"") if size == BLOCK else (7, struct.pack(">H", size - 1))
    raw = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _number(number) + extra
    crc = 0
    for b in raw:
        crc = int(_CRC8[crc ^ b])
    return raw + bytes([crc])


@functools.lru_cache(maxsize=1 << 16)
def _read_header(raw: bytes) -> tuple[int, int, int]:
    """Frame number, samples and header bytes; raises where it is no sound header of this stream."""
    if raw[0] != 0xFF or raw[1] != 0xF8 or raw[3] != 0x02 or raw[2] & 15 != 4:
        raise ValueError("not an 8-bit mono frame")
    lead = raw[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for b in raw[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    at, code = 5 + more, raw[2] >> 4
    if code == 7:
        size, at = struct.unpack(">H", raw[at : at + 2])[0] + 1, at + 2
    elif 8 <= code:
        size = 256 << (code - 8)
    else:
        raise ValueError("block size not in use")
    if _frame_header(number, size)[: at + 1] != raw[: at + 1]:
        raise ValueError("frame header checksum differs")
    return number, size, at + 1


def _encode_frames(samples: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Frames of int32 ``samples`` in stretches (start, size), end to end, and their bytes."""
    n = len(start)
    frame = np.repeat(np.arange(n), size)
    within = np.arange(len(frame)) - np.repeat(np.cumsum(size) - size, size)
    s = samples
    frame = frame.astype(np.int32)
    one, two = np.r_[np.int32(0), s[:-1]], np.r_[np.int32(0), np.int32(0), s[:-2]]
    one[within == 0] = 0
    two[within <= 1] = 0
    heads = np.cumsum(size) - size
    total = lambda x: np.add.reduceat(x, heads).astype(float)
    # least squares of order 2 per frame, as a quantised predictor
    a11, a12, a22, b1, b2 = total(one * one), total(one * two), total(two * two), total(s * one), total(s * two)
    det = a11 * a22 - a12 * a12
    safe = np.where(np.abs(det) > 1e-9, det, 1.0)
    limit = (1 << (PRECISION - 1)) - 1
    to32 = lambda x: x.astype(np.int32)
    c1 = np.clip(np.rint(np.where(det > 1e-9, (b1 * a22 - b2 * a12) / safe, 0) * (1 << SHIFT)), -limit, limit).astype(np.int64)
    c2 = np.clip(np.rint(np.where(det > 1e-9, (b2 * a11 - b1 * a12) / safe, 0) * (1 << SHIFT)), -limit, limit).astype(np.int64)
    best = total(np.abs(s))
    kind = np.zeros(n, np.int64)  # 0..2 fixed, 3 linear
    k1, k2, shift = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for which, (x, y, h) in enumerate(((1, 0, 0), (2, -1, 0)), 1):
        cost = total(np.abs(s - x * one - y * two))
        better = (cost < best) & (size > 2)
        best, kind = np.where(better, cost, best), np.where(better, which, kind)
        k1, k2 = np.where(better, x, k1), np.where(better, y, k2)
    c1, c2 = to32(c1), to32(c2)
    cost = total(np.abs(s - ((c1[frame] * one + c2[frame] * two) >> SHIFT))) + 20
    better = (cost < best) & (size > 2)
    kind, k1, k2, shift = np.where(better, 3, kind), np.where(better, c1, k1), np.where(better, c2, k2), np.where(better, SHIFT, shift)
    order = np.minimum(kind, 2)
    k1, k2, shift = to32(k1), to32(k2), to32(shift)
    r = s - ((k1[frame] * one + k2[frame] * two) >> shift[frame])
    u = np.where(r >= 0, 2 * r, -2 * r - 1)
    coded = within >= order[frame]
    u = np.where(coded, u, 0)
    sums, peak = np.add.reduceat(u, heads), np.maximum.reduceat(u, heads)
    mean = sums / np.maximum(size - order, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64), 1, 14)
    while (over := (peak >> rice) > 15).any():
        rice += over
    k = rice[frame]
    q = u >> k
    length = np.where(coded, q + 1 + k, 8)
    linear = kind == 3
    side = np.where(linear, 9 + 2 * PRECISION, 0)
    head = [_frame_header(i, int(z)) for i, z in zip(numbers, size)]
    hb = np.fromiter(map(len, head), np.int64, n)
    body_bits = 8 + np.add.reduceat(length, heads) + side + 10
    size_bytes = hb + (body_bits + 7) // 8 + 2
    base = np.cumsum(size_bytes) - size_bytes
    body = 8 * (base + hb)
    after = np.add.reduceat(np.where(coded, 0, 8), heads)  # warm-up bits
    place = body + 8 + after
    # fields as (bit after the last, value): they do not overlap, so adding words sets their bits
    fields = [(body + 8, np.where(linear, 0b01000010, 0b00010000 | kind << 1)), (place + side + 10, rice)]  # method 0, one partition
    if linear.any():
        at, mask = place[linear], (1 << PRECISION) - 1
        fields += [(at + 4, np.full(len(at), PRECISION - 1)), (at + 9, np.full(len(at), SHIFT)), (at + 9 + PRECISION, k1[linear] & mask), (at + 9 + 2 * PRECISION, k2[linear] & mask)]
    ends = np.cumsum(length)
    lead = body + 8 - (ends[heads] - length[heads])
    fields.append((ends + lead[frame] + np.where(coded, (side + 10)[frame], 0), np.where(coded, (1 << k) | (u & ((1 << k) - 1)), s & 0xFF)))
    last = np.concatenate([f[0] for f in fields]) - 1
    wide = np.concatenate([f[1] for f in fields]).astype(np.int64) << (31 - (last & 31))
    room = (int(size_bytes.sum()) + 7) // 4 + 1
    word = last >> 5
    words = np.bincount(word + 1, weights=wide & 0xFFFFFFFF, minlength=room + 1) + np.bincount(word, weights=wide >> 32, minlength=room + 1)
    data = np.frombuffer(words[1:].astype(">u4").tobytes(), np.uint8)[: int(size_bytes.sum())].copy()
    flat = np.frombuffer(b"".join(head), np.uint8)
    data[np.repeat(base - (np.cumsum(hb) - hb), hb) + np.arange(len(flat))] = flat
    crc = _crc16(data, base, size_bytes - 2)
    data[base + size_bytes - 2], data[base + size_bytes - 1] = crc >> 8, crc & 0xFF
    return data, size_bytes


def _decode_frames(data: np.ndarray, start: np.ndarray, nbytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Samples of frames at (start, nbytes) of ``data``, end to end; samples by frame; frame numbers."""
    stored = (data[start + nbytes - 2].astype(np.uint16) << 8) | data[start + nbytes - 1]
    if not np.array_equal(_crc16(data, start, nbytes - 2), stored):
        raise ValueError("frame checksum differs")
    raw = data.tobytes()
    heads = [_read_header(raw[a : a + 14]) for a in start.tolist()]
    size = np.array([h[1] for h in heads], np.int64)
    order_in = np.argsort(-size, kind="stable")
    pos = 8 * (start + np.array([h[2] for h in heads]))[order_in]
    sz = size[order_in]
    d = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint32)
    word = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]

    def get(at: np.ndarray, width: int) -> np.ndarray:
        w = word[at >> 3] << (at & 7).astype(np.uint32)
        return (w >> np.uint32(32 - width)).astype(np.int64)

    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    kind = get(pos, 8)
    linear = kind >= 64
    order = np.where(linear, ((kind >> 1) & 31) + 1, (kind >> 1) & 7)
    if ((order > 2) | (~linear & ((kind >> 1) < 8))).any():
        raise ValueError("subframe type not in use")
    pos = pos + 8
    n, longest = len(sz), int(sz[0]) if len(sz) else 0
    grid = np.zeros((longest, n), np.int64)
    for i in range(2):
        has = order > i
        grid[i, has] = signed(get(pos, 8), 8)[has] if longest > i else 0
        pos = pos + 8 * has
    fixed1, fixed2 = np.array([0, 1, 2]), np.array([0, 0, -1])
    c1, c2, shift = fixed1[order], fixed2[order], np.zeros(n, np.int64)
    if linear.any():
        prec = get(pos, 4) + 1
        shift = np.where(linear, get(pos + 4, 5), 0)
        c1 = np.where(linear, signed(get(pos + 9, PRECISION), PRECISION), c1)
        c2 = np.where(linear, signed(get(pos + 9 + PRECISION, PRECISION), PRECISION), c2)
        if (prec[linear] != PRECISION).any():
            raise ValueError("predictor precision not in use")
        pos = pos + np.where(linear, 9 + order * PRECISION, 0)
    rice = get(pos + 6, 4)
    pos = pos + 10
    rice_u, back = rice.astype(np.uint32), (32 - rice).astype(np.uint32)
    live = np.searchsorted(-sz, -np.arange(longest), side="left")
    for i, m in enumerate(live.tolist()):
        p = pos[:m]
        w = word[p >> 3] << (p & 7).astype(np.uint32)
        q = _ZEROS[w >> np.uint32(16)].astype(np.uint32)
        u = ((q << rice_u[:m]) | ((w << (q + np.uint32(1))) >> back[:m])).astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        if i >= 2:
            r += (c1[:m] * grid[i - 1, :m] + c2[:m] * grid[i - 2, :m]) >> shift[:m]
            grid[i, :m] = r
            pos[:m] = p + q + rice[:m] + 1
        else:
            if i == 1:
                r += (c1[:m] * grid[0, :m]) >> shift[:m]
            coded = order[:m] <= i
            grid[i, :m] = np.where(coded, r, grid[i, :m])
            pos[:m] = p + np.where(coded, q + rice[:m] + 1, 0)
    back_to = np.empty(n, np.int64)
    back_to[order_in] = np.arange(n)
    rows = grid.T[back_to]
    return rows[np.arange(longest)[None, :] < size[:, None]], size, [h[0] for h in heads]


def _stream(samples: np.ndarray, frames: bytes, sizes: list[int], at: int) -> bytes:
    """A FLAC stream of frames with their seek table; ``at``: samples in all."""
    points = b"".join(struct.pack(">QQH", k * BLOCK, o, min(BLOCK, at - k * BLOCK)) for k, o in enumerate(np.cumsum([0, *sizes[:-1]]).tolist()))
    least = min(BLOCK, max(16, at))
    info = struct.pack(">HH", least, max(least, BLOCK if at > BLOCK else least)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | at).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + frames


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (of one byte at least)."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    begins = np.cumsum(sizes) - sizes
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[owner] + number * BLOCK
    size = np.minimum(BLOCK, begins[owner] + sizes[owner] - start)
    parts, nbytes = [], []
    for a in range(0, len(start), LANES):
        st, sz = start[a : a + LANES], size[a : a + LANES]
        data, nb = _encode_frames(flat[int(st[0]) : int(st[-1] + sz[-1])].astype(np.int32) - 128, st - st[0], sz, number[a : a + LANES].tolist())
        parts.append(data)
        nbytes.append(nb)
    data, nb = np.concatenate(parts), np.concatenate(nbytes)
    ends, stops, out = np.cumsum(nb), np.cumsum(counts), []
    for b, z, e, c in zip(begins.tolist(), sizes.tolist(), stops.tolist(), counts.tolist()):
        first = int(ends[e - c] - nb[e - c])
        out.append(_stream((flat[b : b + z] ^ 0x80).view(np.int8), data[first : int(ends[e - 1])].tobytes(), nb[e - c : e].tolist(), z))
    return out


def seek_points(stream: bytes) -> tuple[np.ndarray, np.ndarray, int, bytes]:
    """First samples and absolute places of the frames, samples in all and the MD5 of the audio."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total, md5 = 4, False, None, 0, b""
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 36) & 31 != 7 or (packed >> 41) & 7:
                raise ValueError("not 8-bit mono")
            total, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind & 127 == 3:
            points = np.frombuffer(body, np.dtype([("first", ">u8"), ("at", ">u8"), ("n", ">u2")]))
        last, at = bool(kind & 128), at + 4 + size
    if points is None:
        raise ValueError("no seek table")
    return points["first"].astype(np.int64), points["at"].astype(np.int64) + at, total, md5


def decode(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """The payload of each stream; every frame's checksums are verified, and the MD5 of the whole."""
    base, starts, nbytes, owners, totals, sums = 0, [], [], [], [], []
    for k, s in enumerate(streams):
        _, at, total, md5 = seek_points(s)
        starts.append(at + base)
        nbytes.append(np.diff(np.r_[at, len(s)]))
        owners.append(np.full(len(at), k))
        totals.append(total)
        sums.append(md5)
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    start, nb = np.concatenate(starts), np.concatenate(nbytes)
    parts = []
    for a in range(0, len(start), 4 * LANES):
        st, z = start[a : a + 4 * LANES], nb[a : a + 4 * LANES]
        got, _, _ = _decode_frames(data[int(st[0]) : int(st[-1] + z[-1])], st - st[0], z)
        parts.append(got.astype(np.int8))
    flat, at, out = np.concatenate(parts), 0, []
    for total, md5 in zip(totals, sums):
        samples = flat[at : at + total]
        if verify and hashlib.md5(samples.tobytes()).digest() != md5:
            raise ValueError("audio checksum differs")
        out.append((samples.view(np.uint8) ^ 0x80).tobytes())
        at += total
    return out


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media (a FLAC stream) of every whole text.

    Null and empty texts are 64 bytes of 0. Equal texts give equal streams. Repeated rows stay repeated,
    null doc_ids stay null, further columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches_of(batches, 2_000_000):
            texts = b.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            media = encode([payload_of(t) for t in texts]) if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks of FLAC streams (doc_id, media): doc_id, block, sample_offset, n_samples, pcm (bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])

    def run(batches):
        for b in batches_of(batches, 2_000_000):
            rows: list[tuple] = []
            streams = b.column(1).to_pylist()
            for doc_id, s, pcm in zip(b.column(0).to_pylist(), streams, decode(streams) if streams else []):
                first, _, total, _ = seek_points(s)
                for k, (x, y) in enumerate(zip(first.tolist(), [*first.tolist()[1:], total])):
                    rows.append((doc_id, k, x, y - x, pcm[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary")


def feature(pcm: bytes) -> str:
    """Peak, mean, energy, crossings and steps of the samples, as whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x))
    cross = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};min={x.min()};max={x.max()};sum={x.sum()};energy={(x * x).sum()};cross={cross};steps={step.sum()}"


def digest(media: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media), from the samples read back."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2_000_000):
            streams = b.column(2).to_pylist()
            back = decode(streams) if streams else []
            cols = [
                [len(p) for p in back], [hashlib.sha256(p).hexdigest() for p in back], [zlib.crc32(p[-64:]) for p in back],
                [len(s) for s in streams], [hashlib.sha256(s).hexdigest() for s in streams], [feature(p) for p in back],
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:]))], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
