"""Adaptive context-mixing range coder for token ids.

A file holds blocks of ``BLOCK`` ids. Each starts from the same model, so each decodes alone, and each
carries the CRC-32 of its ids. Per id the coder takes one symbol from a mixture of three predictions:

* order 2: the id that last followed the two ids before, with a confidence of 0 (none) to 3,
* order 1: the id that last followed the id before, likewise,
* order 0: adaptive counts of the ids' bit lengths; the bits below the leading one follow at equal odds.

The odds of orders 2 and 1 adapt for each confidence; with the order-0 counts they make up the total
that drives the arithmetic coding. A model takes in what it saw every ``EVERY`` ids. The coder's state
has 48 bits and moves in 16-bit words; a carry runs back into words already written.

All blocks of a batch are coded in lockstep, one NumPy lane a block, so Python's cost is per position
and not per id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 1024
EVERY = 16
MAGIC = b"WIDC\x01\x00\x00\x00"
NONE = 0xFFFF  # no prediction; ids are below it
_T2, _T1 = 4096, 1024  # slots of the prediction tables
_CLASSES = 17  # bit lengths of ids below 65,536
_MOST0, _MOST = 2048, 256  # order-0 counts and hit counts are halved above these
_NEXT = np.zeros((2, 4), np.int64)  # confidence after a miss, after a hit
_NEXT[0], _NEXT[1] = (1, 1, 1, 2), (1, 2, 3, 3)


class _Model:
    def __init__(self, lanes: int):
        self.n, self.at = lanes, np.arange(lanes)
        self.at2, self.at1 = self.at * _T2, self.at * _T1
        self.t2 = np.full(lanes * _T2, NONE, np.int64)  # id | confidence << 16
        self.t1 = np.full(lanes * _T1, NONE, np.int64)
        self.seen = [np.ones((4, 2, lanes)) for _ in range(2)]  # misses and hits by confidence
        self.counts = np.ones((_CLASSES, lanes), np.int64)
        self.prev = np.zeros(lanes, np.int64)
        self.h2 = np.zeros(lanes, np.int64)
        self.keys = [np.zeros((EVERY, lanes), np.int64) for _ in range(3)]
        self.step = 0
        self._rebuild()

    def _rebuild(self):
        self.odds = []
        for s in self.seen:
            o = np.clip(s[:, 1] * 256 / s[:, 0], 8, 3072).astype(np.int64)
            o[0] = 0
            self.odds.append(o.ravel())
        self.cum = np.empty((_CLASSES + 1, self.n), np.int64)
        self.cum[0] = 0
        for c in range(_CLASSES):
            np.add(self.cum[c], self.counts[c], out=self.cum[c + 1])
        self.flat_cum, self.flat_counts, self.total0 = self.cum.ravel(), self.counts.ravel(), self.cum[-1]

    def predict(self):
        n = self.n
        self.i2 = self.at2 + (self.h2 & (_T2 - 1))
        self.i1 = self.at1 + (self.prev & (_T1 - 1))
        e2, e1 = self.t2.take(self.i2), self.t1.take(self.i1)
        self.p2, self.c2 = e2 & 0xFFFF, e2 >> 16
        self.p1, self.c1 = e1 & 0xFFFF, e1 >> 16
        self.k2, self.k1 = self.c2 * n + self.at, self.c1 * n + self.at
        self.a1 = (self.total0 * self.odds[1].take(self.k1)) >> 8
        self.base = self.total0 + self.a1
        self.a2 = (self.base * self.odds[0].take(self.k2)) >> 8
        self.base = self.a1 + self.a2
        return self.base + self.total0

    def update(self, x, is2, is1, cls):
        """``is2``, ``is1``: whether the predictions were right; ``cls``: bit length of what order 0 coded, else _CLASSES."""
        n, k = self.n, self.step % EVERY
        self.keys[0][k] = self.k2 + self.c2 * n + is2 * n
        self.keys[1][k] = self.k1 + self.c1 * n + is1 * n
        self.keys[2][k] = cls * n + self.at
        for t, i, p, c, hit in ((self.t2, self.i2, self.p2, self.c2, is2), (self.t1, self.i1, self.p1, self.c1, is1)):
            new = _NEXT.ravel().take(c + 4 * hit)
            t[i] = np.where(c > 1, p, x) + (new << 16)
        self.h2 = self.prev * 40503 + x * 7919 + (x >> 5)
        self.prev = x
        self.step += 1
        if self.step % EVERY == 0:
            for s, keys in zip(self.seen, self.keys):
                s += np.bincount(keys.ravel(), minlength=8 * n).reshape(4, 2, n)
                s *= np.where(s.sum(axis=1, keepdims=True) > _MOST, 0.5, 1.0)
            self.counts += 24 * np.bincount(self.keys[2].ravel(), minlength=(_CLASSES + 1) * n).reshape(-1, n)[:_CLASSES]
            self.counts = np.where(self.counts.sum(axis=0) > _MOST0, (self.counts + 1) >> 1, self.counts)
            self._rebuild()


_LOW, _FULL = 1 << 32, (1 << 48) - 1


class _Encoder:
    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _FULL, np.int64)
        self.out, self.pos = np.zeros((lanes, most), np.uint16), np.zeros(lanes, np.int64)

    def put(self, r, start, size):
        self.low += start * r
        self.range = r * size
        carry = np.flatnonzero(self.low > _FULL)
        if carry.size:
            self.low[carry] &= _FULL
            at = self.pos[carry] - 1
            while carry.size:
                self.out[carry, at] += 1
                more = self.out[carry, at] == 0
                carry, at = carry[more], at[more] - 1
        i = np.flatnonzero(self.range < _LOW)
        while i.size:
            low = self.low[i]
            self.out[i, self.pos[i]] = low >> 32
            self.pos[i] += 1
            self.low[i] = (low << 16) & _FULL
            self.range[i] <<= 16
            i = i[self.range[i] < _LOW]

    def end(self):
        at = np.arange(len(self.low))
        for k, shift in enumerate((32, 16, 0)):
            self.out[at, self.pos + k] = (self.low >> shift) & 0xFFFF
        self.pos += 3


class _Decoder:
    def __init__(self, words):
        self.words, self.pos = words, np.full(len(words), 3)
        w = words[:, :3].astype(np.int64)
        self.code = (w[:, 0] << 32) | (w[:, 1] << 16) | w[:, 2]
        self.range = np.full(len(words), _FULL, np.int64)

    def take(self, r, start, size):
        self.code -= start * r
        self.range = r * size
        i = np.flatnonzero(self.range < _LOW)
        while i.size:
            self.code[i] = (self.code[i] << 16) | self.words[i, self.pos[i]]
            self.pos[i] += 1
            self.range[i] <<= 16
            i = i[self.range[i] < _LOW]


def _bit_length(x):
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids``: (blocks, ids of a block), each id below ``NONE``."""
    lanes, steps = ids.shape
    model, coder = _Model(lanes), _Encoder(lanes, 3 * steps + 4)
    columns = np.ascontiguousarray(ids.T).astype(np.int64)
    for x in columns:
        total = model.predict()
        is2, is1 = model.p2 == x, model.p1 == x
        hit1 = is1 & ~is2
        literal = ~(is2 | is1)
        cls = _bit_length(x)
        k = cls * model.n + model.at
        start = np.where(is2, 0, np.where(hit1, model.a2, model.base + model.flat_cum.take(k)))
        coder.put(coder.range // total, start, np.where(is2, model.a2, np.where(hit1, model.a1, model.flat_counts.take(k))))
        bits = np.where(literal, np.maximum(cls - 1, 0), 0)
        coder.put(coder.range >> bits, x & ((1 << bits) - 1), 1)
        model.update(x, is2, is1, np.where(literal, cls, _CLASSES))
    coder.end()
    return [coder.out[i, : coder.pos[i]].astype("<u2").tobytes() for i in range(lanes)]


def decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    lanes = len(payloads)
    words = np.zeros((lanes, max(len(p) // 2 for p in payloads) + 4), np.uint16)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    model, coder, out = _Model(lanes), _Decoder(words), np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        total = model.predict()
        r = coder.range // total
        v = np.minimum(coder.code // r, total - 1)
        hit2, literal = v < model.a2, v >= model.base
        hit1 = ~(hit2 | literal)
        v = np.where(literal, v - model.base, 0)
        cls = np.zeros(lanes, np.int64)
        for row in model.cum[1:-1]:
            cls += row <= v
        k = cls * model.n + model.at
        start = np.where(hit2, 0, np.where(hit1, model.a2, model.base + model.flat_cum.take(k)))
        coder.take(r, start, np.where(hit2, model.a2, np.where(hit1, model.a1, model.flat_counts.take(k))))
        bits = np.where(literal, np.maximum(cls - 1, 0), 0)
        r = coder.range >> bits
        low = np.minimum(coder.code // r, (1 << bits) - 1)
        coder.take(r, low, 1)
        x = np.where(hit2, model.p2, np.where(hit1, model.p1, np.where(cls > 0, (1 << np.maximum(cls - 1, 0)) | low, 0)))
        out[t] = x
        model.update(x, model.p2 == x, model.p1 == x, np.where(literal, cls, _CLASSES))
    return out.T.astype(np.uint32)


def write_ids(out, ids: np.ndarray, block: int = BLOCK) -> int:
    """Append blocks with ``ids`` (32-bit, each below 65,535) to a stream; bytes written."""
    if ids.size and int(ids.max()) >= NONE:
        raise ValueError("ids must be below 65,535")
    done = 0
    for a in range(0, len(ids), block * LANES):
        part = ids[a : a + block * LANES]
        lanes = -(-len(part) // block)
        steps = min(block, len(part))
        padded = np.zeros(lanes * steps if lanes == 1 else lanes * block, np.uint32)
        padded[: len(part)] = part
        for i, payload in enumerate(encode_blocks(padded.reshape(lanes, -1))):
            own = part[i * block : (i + 1) * block].astype("<u4").tobytes()
            head = struct.pack("<IIII", len(own) // 4, steps, len(payload), zlib.crc32(own))
            out.write(head + payload)
            done += len(head) + len(payload)
    return done


def read_ids(data, size: int | None = None):
    """Yield arrays of ids, a batch of blocks each, from what ``write_ids`` wrote: bytes, or ``size`` bytes of a stream. Memory holds
    ``LANES`` blocks. Raises ValueError on damage."""
    import io

    if not hasattr(data, "read"):
        data, size = io.BytesIO(data), len(data)
    ahead, left = None, size
    while left or ahead:
        heads, payloads = [], []
        while (left or ahead) and len(heads) < LANES:
            if ahead is None:
                raw = data.read(16)
                if len(raw) < 16:
                    raise ValueError("a block is cut off")
                ahead, left = struct.unpack("<IIII", raw), left - 16
            if heads and ahead[1] != heads[0][1]:
                break
            payload = bytes(data.read(ahead[2]))
            if len(payload) != ahead[2]:
                raise ValueError("a block is cut off")
            left -= ahead[2]
            heads.append(ahead)
            payloads.append(payload)
            ahead = None
        ids = decode_blocks(payloads, heads[0][1])
        for row, (count, _, _, crc) in zip(ids, heads):
            if zlib.crc32(row[:count].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum differs")
        yield np.concatenate([row[: h[0]] for row, h in zip(ids, heads)])
