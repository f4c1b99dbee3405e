"""The FLAC encoder against a decoder written from the format, bit by bit, and blocks sought by offset."""

import numpy as np

from voluma.llm import flac


class Bits:
    def __init__(self, data):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.text[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def zeros(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def brute_decode(stream):
    """Samples and subframe types of a stream of 8-bit mono frames."""
    at, last = 4, False
    while not last:
        last, size = stream[at] >= 128, int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
    bits, out, kinds = Bits(stream[at:]), [], []
    while bits.at < len(bits.text):
        assert bits.take(16) == 0xFFF8
        code = bits.take(4)
        assert bits.take(12) == 0x002
        first = bits.take(8)
        while first >= 0xC0 and (first << 1) & 0x80:
            bits.take(8)
            first = (first << 1) & 0xFF
        n = bits.take(16) + 1 if code == 7 else 256 << (code - 8)
        bits.take(8)
        kind = bits.take(8) >> 1
        kinds.append(kind)
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(8) for _ in range(order)]
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            c = [bits.signed(precision) for _ in range(order)]
        else:
            shift, c = 0, {0: [], 1: [1], 2: [2, -1]}[order]
        assert bits.take(6) == 0
        k = bits.take(4)
        for _ in range(n - order):
            u = bits.zeros() << k
            u |= bits.take(k) if k else 0
            x.append(((u >> 1) ^ -(u & 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        bits.at = -(-bits.at // 8) * 8 + 16
        out += x
    return bytes(v + 128 for v in out), kinds


def test_streams_follow_the_format():
    rng = np.random.default_rng(3)
    wave = (128 + 90 * np.sin(np.arange(9000) / 7) + rng.normal(0, 2, 9000)).clip(0, 255).astype(np.uint8).tobytes()
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(2000)).encode()
    payloads = [wave[:8960], prose[:8192], bytes(64), bytes(rng.integers(0, 256, 4160, dtype=np.uint8)), b"\x00\xff" * 2048, wave[:128]]
    streams, kinds = flac.encode(payloads), set()
    for payload, stream, blocks in zip(payloads, streams, flac.decode(streams)):
        found, own = brute_decode(stream)
        kinds |= set(own)
        assert found == payload == bytes(x ^ 0x80 for b in blocks for x in b[2])
    assert 35 in kinds and kinds & {8, 9, 10}  # quantised and fixed predictors
    without = sum(len(p) for p in payloads[:2])
    assert len(streams[0]) + len(streams[1]) < 0.8 * without


def test_stored_blocks_are_sought_by_offset(spark):
    texts = [b"abc" * 4000, None, b"", b"x" * 5000]
    rows = spark.createDataFrame([(i, bytearray(t) if t is not None else None, "m", 1) for i, t in enumerate(texts)] + [(3, bytearray(texts[3]), "m", 1)], "doc_id long, payload binary, media string, pcm int")
    media = flac.store_media(rows)
    blocks = flac.store_blocks(media)
    assert blocks.columns == ["doc_id", "n_bytes", "block", "sample_offset", "n_samples", "pcm"]
    found = {r.doc_id: bytes(x ^ 0x80 for x in r.pcm) for r in flac.samples_of(blocks.where("doc_id <> 3"), 4090, 20).collect()}
    assert found == {0: (b"abc" * 4000)[4090:4110]}
    features = flac.media_features(media)
    assert features.where("doc_id = 3").count() == 2 and features.where("doc_id = 3").drop("doc_id").distinct().count() == 1
    assert flac.media_features(flac.store_media(rows.limit(0))).count() == 0


def test_a_header_inside_a_frame_is_no_frame():
    """A verbatim-like run of bytes that forms the next frame's header, with its checksum, inside the first frame."""
    fake = bytes([128 ^ b for b in flac.frame_header(1, 4096)])
    rng = np.random.default_rng(5)
    n = 2 * 4096
    body = rng.integers(0, 256, n, dtype=np.uint8)
    subframe = lambda x: bytes([2]) + bytes(v ^ 0x80 for v in x)
    body[100 : 100 + len(fake)] = list(fake)
    frames = b""
    for i in range(2):
        frame = flac.frame_header(i, 4096) + subframe(body[i * 4096 : (i + 1) * 4096].tolist())
        frames += frame + int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    packed = (8000 << 44) | (7 << 36) | n
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80\x00\x00\x22" + info + frames
    assert flac.frame_header(1, 4096) in stream[42 + 20 : 42 + 400]
    assert b"".join(bytes(x ^ 0x80 for x in b[2]) for b in flac.decode([stream])[0]) == body.tobytes()
