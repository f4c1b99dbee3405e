"""FLAC media columns: lossless 8-bit mono streams, decoded to PCM blocks with sample offsets.

Streams are handled many frames at a time: the encoder lays the Rice codes of a chunk's frames into one bit array; the decoder
walks all frames of a chunk in step, one residual each, with the frames' own cursors.  Every frame's header and body checksum
is verified.  The encoder takes, frame by frame, the shortest of the fixed linear predictors of order 0 to 2 and a quantised linear
predictor that is fitted to the frame; the decoder reads any order, verbatim and constant subframes, Rice partitions, escaped
partitions and wasted bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Samples of a frame, bytes that a chunk of rows holds, and the padding unit of payloads.
BLOCK, CHUNK_BYTES, UNIT = 4096, 1 << 20, 64
SAMPLE_RATE = 8000
#: Order of the encoder's quantised predictors and bits of a coefficient; shorter frames have none.
ORDER, PRECISION, LEAST_PREDICTED = 4, 10, 64
#: Fixed value: samples of the block-size codes 8 to 15.
BLOCK_CODES = {8 + i: 256 << i for i in range(8)}


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Checksum register after ``bits`` more bits, by the register's (and data's) top ``bits``."""
    x = np.arange(1 << bits, dtype=np.uint32) << np.uint32(width - bits)
    for _ in range(bits):
        x = ((x << np.uint32(1)) ^ np.where(x >> np.uint32(width - 1) & np.uint32(1), np.uint32(poly), np.uint32(0))) & np.uint32((1 << width) - 1)
    return x


CRC8 = _crc_table(0x07, 8, 8).tolist()
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = CRC8[out ^ b]
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once: set against the right edge, as leading zeros leave the register at zero."""
    if len(starts) == 0:
        return np.zeros(0, np.uint16)
    width = int((ends - starts).max()) + 1 & ~1
    rows = np.zeros((len(starts), width), np.uint8)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        rows[i, width - (b - a) :] = data[a:b]
    words = np.ascontiguousarray(rows.view(">u2").astype(np.uint16).T)
    out = np.zeros(len(starts), np.uint16)
    for w in words:
        out = CRC16[out ^ w]
    return out


# Encoding


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n > (0x3F >> len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF80 >> len(tail)) & 0xFF | n, *reversed(tail)])


def frame_header(number: int, samples: int) -> bytes:
    code = next((c for c, n in BLOCK_CODES.items() if n == samples), 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + ((samples - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([crc8(head)])


def fitted(x: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised linear predictor of each frame: coefficients (nearest sample first), shifts, and the residuals of all samples."""
    padded = np.concatenate([np.zeros(ORDER, np.int32), x])
    back = [padded[ORDER - j : len(padded) - j] for j in range(ORDER + 1)]  # the sample j places before
    cuts = [np.where(at >= j, back[j], 0) for j in range(ORDER + 1)]
    r = np.stack([np.add.reduceat((x * c).astype(np.float64), starts) for c in cuts])  # autocorrelation
    error, c = r[0] * (1 + 1e-9) + 1e-6, np.zeros((ORDER, len(starts)))
    for i in range(ORDER):  # Levinson's recursion
        k = (r[i + 1] - (c[:i] * r[i:0:-1]).sum(axis=0)) / error
        c[:i], c[i] = c[:i] - k * c[:i][::-1], k
        error = error * np.maximum(1 - k * k, 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(c).max(axis=0), 1e-6))), 0, 15).astype(np.int64)
    q = np.clip(np.rint(c * (1 << shift)), -top - 1, top).astype(np.int32)
    guess = sum(np.repeat(q[j], lengths) * cuts[j + 1] for j in range(ORDER))
    return q, shift, x - (guess >> np.repeat(shift, lengths).astype(np.int32))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (not empty), one byte a sample."""
    sizes = np.array([len(p) for p in payloads])
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    x = (joined.astype(np.int32) - 128)
    first = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(first[:-1], first[1:])])
    lengths = np.minimum(starts + BLOCK, first[np.searchsorted(first, starts, side="right")]) - starts
    owner = np.searchsorted(first, starts, side="right") - 1
    number = (starts - first[owner]) // BLOCK
    # Residuals of the fixed predictors of order 0 to 2, and the cheapest of each frame.
    at = np.arange(len(x)) - np.repeat(starts, lengths)
    d1 = np.concatenate([[0], np.diff(x)])
    d2 = np.concatenate([[0], np.diff(d1)])
    cost = np.stack([np.add.reduceat(np.where(at >= p, np.abs(d), 0), starts) for p, d in enumerate((x, d1, d2))])
    order = cost.argmin(axis=0)
    q, shift, d4 = fitted(x, at, starts, lengths)
    linear_cost = np.add.reduceat(np.where(at >= ORDER, np.abs(d4), 0), starts)
    # A halved mean saves a bit a sample; the predictor has to save more bits than it takes.
    gain = (lengths - ORDER) * np.log2(np.maximum(cost.min(axis=0), 1) / np.maximum(linear_cost, 1))
    linear = (lengths >= LEAST_PREDICTED) & (gain > 9 + ORDER * (PRECISION + 8))
    order[linear] = ORDER
    own = np.repeat(order, lengths)
    r = np.where(own == 0, x, np.where(own == 1, d1, np.where(own == 2, d2, d4)))
    coded = at >= own
    u = np.where(coded, (r << 1) ^ (r >> 31), 0)
    mean = np.add.reduceat(u, starts) / np.maximum(1, lengths - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int64)
    own_k = np.repeat(k, lengths)
    high = u >> own_k
    bits = np.where(coded, high + 1 + own_k, 0)
    headers = [frame_header(n, s) for n, s in zip(number.tolist(), lengths.tolist())]
    head = np.array([len(h) for h in headers])
    prefix = 8 + 8 * order + 10 + np.where(linear, 9 + ORDER * PRECISION, 0)  # up to the first residual
    body = prefix + np.add.reduceat(bits, starts)
    frame_bytes = head + (body + 7) // 8 + 2
    frame_at = np.concatenate([[0], np.cumsum(frame_bytes)])
    out = np.zeros(int(frame_at[-1]) * 8, np.uint8)
    # Residual codes: zeros, a one, and the low bits.
    code_at = np.cumsum(bits) - bits
    code_at += np.repeat((frame_at[:-1] + head) * 8 + prefix - code_at[starts], lengths)
    code_at, low, width = (code_at + high)[coded], u[coded], own_k[coded]
    out[code_at] = 1
    for j in range(int(k.max())):
        has = width > j
        out[code_at[has] + 1 + j] = low[has] >> (width[has] - 1 - j) & 1
    for i in np.flatnonzero(linear).tolist():  # subframe head, warm-up samples, predictor, Rice parameter
        fields = [((31 + ORDER) << 1, 8), *((int(v) & 0xFF, 8) for v in x[starts[i] : starts[i] + ORDER]), (PRECISION - 1, 4), (int(shift[i]), 5)]
        fields += [(int(v) & (1 << PRECISION) - 1, PRECISION) for v in q[:, i]] + [(0, 6), (int(k[i]), 4)]
        begin = (int(frame_at[i]) + int(head[i])) * 8
        out[begin : begin + int(prefix[i])] = np.frombuffer("".join(f"{v:0{n}b}" for v, n in fields).encode(), np.uint8) - 48
    whole = np.packbits(out)
    for i, h in enumerate(headers):  # frame heads, subframe heads, warm-up samples, Rice parameter
        a, p = int(frame_at[i]), int(order[i])
        whole[a : a + len(h)] = list(h)
        a += len(h)
        if linear[i]:
            continue
        whole[a] = (8 | p) << 1
        whole[a + 1 : a + 1 + p] = joined[starts[i] : starts[i] + p] ^ 0x80
        whole[a + 1 + p] |= int(k[i]) >> 2 & 3  # two bits of method and four of partitions are 0
        whole[a + 2 + p] |= (int(k[i]) & 3) << 6
    ends = frame_at[1:] - 2
    sums = crc16(whole, frame_at[:-1], ends)
    whole[ends], whole[ends + 1] = sums >> 8, sums & 0xFF
    streams, f = [], 0
    for payload in payloads:
        n = -(-len(payload) // BLOCK)
        mine = frame_at[f : f + n + 1]
        points = b"".join(int(i * BLOCK).to_bytes(8, "big") + int(a - mine[0]).to_bytes(8, "big") + int(s).to_bytes(2, "big") for i, (a, s) in enumerate(zip(mine, lengths[f : f + n])))
        size, frames = min(BLOCK, len(payload)), np.diff(mine)
        packed = (SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        info = size.to_bytes(2, "big") * 2 + int(frames.min()).to_bytes(3, "big") + int(frames.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + whole[mine[0] : mine[-1]].tobytes())
        f += n
    return streams


# Decoding


class Stream:
    """Metadata of a stream: sample bits, samples, md5, seek points (sample, byte offset, samples), where its frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.seek = 4, False, []
        while not last:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            block, last = data[at + 4 : at + 4 + size], kind >= 0x80
            if kind & 0x7F == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.rate, channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.block, self.md5 = int.from_bytes(block[2:4], "big"), block[18:34]
                if channels != 1 or self.bits not in (8, 16):
                    raise ValueError("only mono streams of 8 or 16 bits are read")
            elif kind & 0x7F == 3:
                points = (block[i : i + 18] for i in range(0, size - 17, 18))
                self.seek = [(int.from_bytes(p[:8], "big"), int.from_bytes(p[8:16], "big"), int.from_bytes(p[16:], "big")) for p in points if p[:8] != b"\xff" * 8]
            at += 4 + size
        self.start, self.data = at, data

    def frames(self, start: int | None = None) -> list[tuple[int, int, int, int]]:
        """(first byte, subframe byte, samples, first sample) of each frame from ``start``.

        A frame begins at a sync code whose header checksum is right and whose number follows, where the frame before ends with its
        own checksum: the same bytes may stand inside a frame by chance.
        """
        out, at, number = [], self.start if start is None else start, None
        known = {self.start + p[1] for p in self.seek}
        while (at := self.data.find(b"\xff\xf8", at)) >= 0:
            found = _read_header(self.data, at)
            if found and number in (None, found[0]) and (not out or at in known or self._ends(out[-1][0], at)):
                out.append((at, at + found[2], found[1], found[0] * self.block))
                number = found[0] + 1
                at += found[2]
            else:
                at += 1
        return out

    def _ends(self, first: int, end: int) -> bool:
        """Whether a frame that begins at ``first`` has its checksum right before ``end``."""
        data = np.frombuffer(self.data, np.uint8)
        return int(crc16(data, np.array([first]), np.array([end - 2]))[0]) == int(data[end - 2]) << 8 | int(data[end - 1])


def _read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, samples, header bytes), or None if the bytes there are no header of a fixed-size stream."""
    head = data[at : at + 16]
    if len(head) < 6:
        return None
    first, n = head[4], 0
    while first << n & 0x80 and n < 7:
        n += 1
    number = first & 0x7F >> n if n else first
    for b in head[5 : 4 + max(n, 1)]:
        number = number << 6 | b & 0x3F
    end, code = 4 + max(n, 1), head[2] >> 4
    if code == 6:
        samples, end = head[end] + 1, end + 1
    elif code == 7:
        samples, end = int.from_bytes(head[end : end + 2], "big") + 1, end + 2
    elif code >= 8:
        samples = BLOCK_CODES[code]
    elif code:
        samples = 192 if code == 1 else 576 << (code - 2)
    else:
        return None
    end += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if end >= len(head) or crc8(head[:end]) != head[end]:
        return None
    return number, samples, end + 1


def _bits(data: np.ndarray, at: int, n: int) -> int:
    if n == 0:
        return 0
    a, b = at >> 3, (at + n + 7) >> 3
    return int.from_bytes(data[a:b].tobytes(), "big") >> (8 * b - at - n) & (1 << n) - 1


def _signed(value: int, n: int) -> int:
    return value - (1 << n) if n and value >> (n - 1) else value


def decode_frames(data: np.ndarray, frames: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """Samples of each frame (first byte, subframe byte, end byte, samples * 64 + sample bits); raises on a wrong checksum."""
    starts, ends = np.array([f[0] for f in frames], np.int64), np.array([f[2] for f in frames], np.int64)
    sums = crc16(data, starts, ends - 2)
    bad = np.flatnonzero(sums != data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])
    if len(bad):
        raise ValueError(f"checksum of the frame at byte {starts[bad[0]]} is wrong")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(frames)
    rice, windows = [], None
    for i, (_, sub, _, packed) in enumerate(frames):
        samples, bits = packed >> 6, packed & 63
        kind, at, wasted = int(data[sub]) >> 1 & 63, sub * 8 + 8, 0
        if data[sub] & 1:
            while not _bits(data, at + wasted, 1):
                wasted += 1
            wasted += 1
            at += wasted
            bits -= wasted
        if kind == 0:
            out[i] = np.full(samples, _signed(_bits(data, at, bits), bits), np.int64) << wasted
        elif kind == 1:
            out[i] = np.array([_signed(_bits(data, at + j * bits, bits), bits) for j in range(samples)], np.int64) << wasted
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind <= 12 else kind - 31
            warm = [_signed(_bits(data, at + j * bits, bits), bits) for j in range(order)]
            at += order * bits
            predictor, shift = None, 0
            if kind >= 32:
                precision, shift = _bits(data, at, 4) + 1, _signed(_bits(data, at + 4, 5), 5)
                predictor = [_signed(_bits(data, at + 9 + j * precision, precision), precision) for j in range(order)]
                at += 9 + order * precision
            rice.append((samples, i, order, warm, predictor, shift, at + 6, 4 + _bits(data, at, 2), _bits(data, at + 2, 4), wasted))
        else:
            raise ValueError(f"subframe type {kind} is reserved")
    if rice:
        rice.sort(key=lambda f: -f[0])
        for f, x in zip(rice, _predicted(rice, _residuals(data, rice))):
            out[f[1]] = x << f[9]
    return out


def _residuals(data: np.ndarray, rice: list[tuple]) -> np.ndarray:
    """Residuals of frames (longest first), a column each from its predictor's order on, all read in step."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        window |= padded[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)
    samples, order = (np.array([f[j] for f in rice], np.int64) for j in (0, 2))
    pos, field, parts = (np.array([f[j] for f in rice], np.int64) for j in (6, 7, 8))
    k, raw = np.zeros(len(rice), np.int64), np.full(len(rice), -1, np.int64)
    out = np.zeros((int(samples.max()), len(rice)), np.int32)
    begins: dict[int, list[int]] = {}
    for j in range(len(rice)):
        size = int(samples[j] >> parts[j])
        for p in range(1 << int(parts[j])):
            begins.setdefault(max(p * size, int(order[j])), []).append(j)
    active, least = len(rice), int(order.min())
    one, eleven, top = np.uint64(1), np.uint64(11), np.uint64(63)
    uneven = bool((order != least).any())
    for i in range(least, int(samples[0])):
        while samples[active - 1] <= i:
            active -= 1
        for j in begins.get(i, ()):
            k[j] = _bits(data, int(pos[j]), int(field[j]))
            pos[j] += field[j]
            raw[j] = -1
            if k[j] == (1 << int(field[j])) - 1:
                raw[j] = _bits(data, int(pos[j]), 5)
                pos[j] += 5
        p, own = pos[:active], k[:active]
        w = window[p >> 3] << (p & 7).astype(np.uint64)
        q = 1075 - ((w >> eleven).astype(np.float64).view(np.int64) >> 52)
        special = (q > 40) | (raw[:active] >= 0)
        if uneven:
            special |= order[:active] > i
        rest = (w << (q + 1).astype(np.uint64) & np.uint64(0xFFFFFFFFFFFFFFFF)) >> one >> (top - own.astype(np.uint64))
        u = (q << own) | rest.astype(np.int64)
        step = q + 1 + own
        value = (u >> 1) ^ -(u & 1)
        if special.any():
            for j in np.flatnonzero(special).tolist():
                if order[j] > i:
                    value[j], step[j] = 0, 0
                elif raw[j] >= 0:
                    value[j], step[j] = _signed(_bits(data, int(pos[j]), int(raw[j])), int(raw[j])), raw[j]
                else:
                    n = 0
                    while not _bits(data, int(pos[j]) + n, 1):
                        n += 1
                    v = n << int(k[j]) | _bits(data, int(pos[j]) + n + 1, int(k[j]))
                    value[j], step[j] = (v >> 1) ^ -(v & 1), n + 1 + int(k[j])
        out[i, :active] = value
        p += step
    return out


def _predicted(rice: list[tuple], residuals: np.ndarray) -> list[np.ndarray]:
    """Samples of each frame (longest first) from its warm-up samples and residuals; those of quantised predictors in step."""
    linear: dict[int, list[int]] = {}
    for j, f in enumerate(rice):
        if f[4] is not None:
            linear.setdefault(f[2], []).append(j)
    done = {}
    for order, frames in linear.items():
        x = residuals[: rice[frames[0]][0], frames].astype(np.int64)
        sizes = np.array([rice[j][0] for j in frames])
        c = np.array([rice[j][4] for j in frames], np.int64).T  # nearest sample first
        shift = np.array([rice[j][5] for j in frames], np.int64)
        x[:order] = np.array([rice[j][3] for j in frames], np.int64).T
        active = len(frames)
        for i in range(order, len(x)):
            while sizes[active - 1] <= i:
                active -= 1
            x[i, :active] += (x[i - order : i, :active][::-1] * c[:, :active]).sum(axis=0) >> shift[:active]
        done |= {j: x[: sizes[n], n] for n, j in enumerate(frames)}
    out = []
    for j, (samples, _, order, warm, predictor, *_) in enumerate(rice):
        if predictor is not None:
            out.append(done[j])
            continue
        x = residuals[:samples, j].astype(np.int64)
        for p in range(order, 0, -1):  # sum up the differences of each degree from its first value on
            d = np.array(warm, np.int64)
            for _ in range(p - 1):
                d = np.diff(d)
            x[p - 1] = d[0]
            x[p - 1 :] = np.cumsum(x[p - 1 :])
        out.append(x)
    return out


def decode(streams: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """PCM blocks of each stream: (sample offset, samples, bytes: 8-bit signed or 16-bit little-endian); the MD5 is verified."""
    heads = [Stream(s) for s in streams]
    jobs, owners, base = [], [], 0
    for i, s in enumerate(heads):
        own = s.frames()
        for j, (a, sub, samples, first) in enumerate(own):
            end = own[j + 1][0] if j + 1 < len(own) else len(s.data)
            jobs.append((base + a, base + sub, base + end, samples << 6 | s.bits))
            owners.append((i, first))
        base += len(s.data)
    whole = np.frombuffer(b"".join(streams), np.uint8)
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in streams]
    for (i, first), x in zip(owners, decode_frames(whole, jobs)):
        out[i].append((first, len(x), x.astype("<i1" if heads[i].bits == 8 else "<i2").tobytes()))
    for s, blocks in zip(heads, out):
        pcm = b"".join(b[2] for b in blocks)
        if len(pcm) * 8 != s.samples * s.bits or s.md5 != bytes(16) and hashlib.md5(pcm).digest() != s.md5:
            raise ValueError("decoded samples do not fit the stream's length and MD5")
    return out


def read_samples(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples first .. first + n - 1, decoding only from the last seek point before them."""
    s = Stream(stream)
    points = [p for p in s.seek if p[0] <= first]
    own = s.frames(s.start + points[-1][1] if points else None)
    ends = [f[0] for f in own[1:]] + [len(stream)]
    used = [(f, e) for f, e in zip(own, ends) if f[3] + f[2] > first and f[3] < first + n]
    if not used:
        return np.zeros(0, np.int64)
    x = np.concatenate(decode_frames(np.frombuffer(stream, np.uint8), [(a, sub, e, size << 6 | s.bits) for (a, sub, size, _), e in used]))
    at = first - used[0][0][3]
    return x[at : at + n]


# Media columns

BLOCKS = "array<struct<sample_offset:long,n_samples:int,pcm:binary>>"


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > CHUNK_BYTES:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [b if b is not None else b"" for b in batch.column(1).to_pylist()]
        padded = [b + bytes(-len(b) % UNIT or (0 if b else UNIT)) for b in raw]
        for a, b in _runs([len(p) for p in padded]):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw[a:b]], pa.int64()), pa.array(encode(padded[a:b]), pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(rows: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """doc_id, n_bytes, media: each binary payload (null: empty), zero-padded to a positive multiple of 64, as a FLAC stream.

    Equal payloads give equal streams, repeated rows repeated results, an empty table none; other columns are not read.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(payload_col)).mapInArrow(_encoder, f"doc_id {kind}, n_bytes long, media binary")


def store_media(rows: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """The streams of ``encode_media`` as a table in the shared folder, read back."""
    return stored(encode_media(rows, id_col, payload_col), "media", "zstd")


def store_blocks(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """The PCM blocks of ``pcm_blocks`` as a table in the shared folder, to be sought by sample_offset."""
    return stored(pcm_blocks(rows, media_col), "pcm", "zstd")


def samples_of(blocks: DataFrame, first: int, n: int, id_col: str = "doc_id") -> DataFrame:
    """id, pcm: samples first .. first + n - 1 of every stream of 8 bits, from the stored blocks that hold some of them.

    Ranges that reach past a stream give what there is; streams without a sample in the range give no row.
    """
    at, end = F.col("sample_offset"), F.col("sample_offset") + F.col("n_samples")
    used = blocks.where((end > first) & (at < first + n))  # reaches the scan as a filter
    start, stop = F.greatest(first - at, F.lit(0)), F.least(first + n - at, F.col("n_samples").cast("long"))
    piece = F.substring("pcm", (start + 1).cast("int"), (stop - start).cast("int"))
    parts = used.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sample_offset", piece.alias("pcm")))).alias("p"))
    return parts.select(id_col, F.aggregate("p", F.expr("cast('' as binary)"), lambda s, p: F.concat(s, p["pcm"])).alias("pcm"))


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))
    for batch in batches:
        media = batch.column("media").to_pylist()
        for a, b in _runs([len(m) for m in media]):
            blocks = [[{"sample_offset": o, "n_samples": n, "pcm": pcm} for o, n, pcm in own] for own in decode(media[a:b])]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks, kind)], [*part.schema.names, "blocks"])


def decode_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Every row with a FLAC stream in ``media_col``, with its PCM blocks in one more column.

    blocks: an array of (sample_offset, n_samples, pcm), in order.  Rows without a stream are left out.  A wrong checksum,
    length or MD5 raises ValueError.  Repeated rows give repeated results, an empty table none; a column ``blocks`` is replaced.
    """
    rows = rows.where(F.col(media_col).isNotNull())
    if media_col != "media":
        rows = rows.drop("media").withColumnRenamed(media_col, "media")
    rows = rows.drop("blocks")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoder, f"{kinds}, blocks {BLOCKS}")


def pcm_blocks(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per PCM block: the other columns of ``rows``, block (from 0), sample_offset, n_samples, pcm.

    Rows without a stream give none; repeated rows give repeated blocks; columns with the names of the block's are replaced.
    """
    found = decode_media(rows, media_col)
    keep = [c for c in found.columns if c.lower() not in ("media", "blocks", "block", "sample_offset", "n_samples", "pcm")]
    return found.select(*keep, F.posexplode("blocks").alias("block", "b")).select(*keep, "block", "b.*")


def _tail(blocks: list[dict], first: int) -> bytes:
    """Payload bytes from sample ``first`` on, from the blocks whose sample offsets reach it."""
    used = [b for b in blocks if b["sample_offset"] + b["n_samples"] > first]
    pcm = b"".join(b["pcm"] for b in used)[first - used[0]["sample_offset"] :]
    return (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decoder(batches):
        rows = []
        for media, blocks in zip(batch.column("media").to_pylist(), batch.column("blocks").to_pylist()):
            x = np.frombuffer(b"".join(b["pcm"] for b in blocks), np.int8)
            payload = (x.view(np.uint8) ^ 0x80).tobytes()
            tail = _tail(blocks, len(x) - UNIT)
            wide = x.astype(np.int32)
            crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            feature = f"peak={int(np.abs(wide).max())};sum={int(wide.sum())};energy={int((wide * wide).sum())};crossings={crossings};blocks={len(blocks)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = [pa.array(c) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(rows: DataFrame) -> DataFrame:
    """Of rows of encode_media: doc_id, n_bytes, and sizes, digests and features of what the stored streams give back.

    A wrong checksum, length or MD5 raises ValueError; repeated rows give repeated results, an empty table none.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_featurer, schema)
