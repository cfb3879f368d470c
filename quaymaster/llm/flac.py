"""A FLAC codec in numpy for mono 8-bit streams, vectorised over the frames of many streams.

Frames of all streams of a batch advance in lockstep: one step handles one sample (or one byte, for
checksums) of every frame.  The reader takes constant, verbatim, fixed and LPC subframes, Rice
partitions of any order and escaped partitions; it finds frames by the seek table, which the writer
gives a point for every frame.  Frame numbers, CRC-8, CRC-16 and the stream's MD5 are verified.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 1024
RATE = 8000
# Fixed values of the format: codes of block sizes, the generators of both checksums, fixed predictors.
BLOCK_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}

_CODE_BLOCKS = np.zeros(16, dtype=np.int64)
for _n, _c in BLOCK_CODES.items():
    _CODE_BLOCKS[_c] = _n
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 9, 7
MAX_UNARY = 48


def _crc_table(poly: int, bits: int) -> np.ndarray:
    rows = []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        rows.append(x)
    return np.array(rows, dtype=np.int64)


_CRC8, _CRC16 = _crc_table(CRC8_POLY, 8), _crc_table(CRC16_POLY, 16)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, wide: bool) -> np.ndarray:
    """The checksum of data[start : start + size] for every lane."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if size.size else 0), side="left")
    state = np.zeros(start.size, dtype=np.int64)
    for i, n in enumerate(active):
        byte = data[start[:n] + i]
        if wide:
            state[:n] = ((state[:n] << 8) & 0xFFFF) ^ _CRC16[(state[:n] >> 8) ^ byte]
        else:
            state[:n] = _CRC8[state[:n] ^ byte]
    out = np.empty_like(state)
    out[order] = state
    return out


def _utf8_size(number: np.ndarray) -> np.ndarray:
    return 1 + (number >= 1 << 7) + (number >= 1 << 11) + (number >= 1 << 16) + (number >= 1 << 21) + (number >= 1 << 26)


class _Bits:
    """Disjoint bit fields of at most 16 bits, gathered into bytes."""

    def __init__(self, size: int):
        self.size, self.out = size, np.zeros(size + 3, dtype=np.uint8)

    def put(self, end: np.ndarray, value: np.ndarray, apart: bool = False) -> None:
        """``value`` so that its lowest bit is the bit before position ``end``; ``apart``: no two share bytes."""
        last = end - 1
        wide = value.astype(np.int32) << (7 - (last & 7)).astype(np.int32)
        at = (last >> 3) + 2
        for shift in (0, 8, 16):
            byte = (wide >> shift) & 255
            if apart:
                self.out[at - shift // 8] |= byte.astype(np.uint8)
            elif at.size:
                low = int(at[0]) - 2
                self.out[low : int(at[-1]) + 1] |= np.bincount(at - (low + shift // 8), weights=byte, minlength=int(at[-1]) + 1 - low).astype(np.uint8)

    def bytes(self) -> np.ndarray:
        return self.out[2 : 2 + self.size]


def _lpc(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order LPC_ORDER for every row of ``x`` (autocorrelation, Levinson-Durbin)."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, : f.shape[1] - k] * f[:, k:]).sum(axis=1) for k in range(LPC_ORDER + 1)])
    a = np.zeros((LPC_ORDER, len(x)))
    error = np.maximum(r[0], 1e-9)
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / error
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -most, most).astype(np.int64).T


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream per payload of unsigned 8-bit samples; every payload has at least 16."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    per = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    stream = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(first[-1]) - first[stream]
    base = (np.cumsum(sizes) - sizes)[stream] + number * BLOCK
    n = np.minimum(BLOCK, sizes[stream] - number * BLOCK)
    frames = np.arange(len(n))

    column = np.arange(BLOCK)
    inside = column < n[:, None]
    x = np.where(inside, raw[np.minimum(base[:, None] + column, raw.size - 1)].astype(np.int32) - 128, 0)

    # fixed predictors of order 0 to 2, and LPC: the one with the smallest residuals, then its best Rice parameter
    coefs = _lpc(x, n)
    least = np.full(len(n), np.iinfo(np.int64).max)
    kind, residual = np.zeros(len(n), dtype=np.int64), np.zeros_like(x)
    for candidate in (0, 1, 2, 100):
        order = candidate if candidate < 100 else LPC_ORDER
        taps = [np.int32(c) for c in FIXED[order]] if candidate < 100 else [coefs[:, i : i + 1].astype(np.int32) for i in range(order)]
        e = x.copy()
        if order:
            p = sum(c * x[:, order - 1 - i : BLOCK - 1 - i] for i, c in enumerate(taps))
            e[:, order:] -= p if candidate < 100 else p >> LPC_SHIFT
        u = np.where(inside & (column >= order), (e << 1) ^ (e >> 31), 0)
        size = u.sum(axis=1, dtype=np.int64) + 200 * order
        better = size < least
        least[better], kind[better] = size[better], candidate
        residual[better] = u[better]
    order = np.where(kind == 100, LPC_ORDER, kind)
    head = 8 * order + np.where(kind == 100, 9 + LPC_ORDER * LPC_PRECISION, 0)
    top = residual.max(axis=1)
    best_bits, rice = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), dtype=np.int64)
    guess = np.log2(np.maximum(residual.sum(axis=1) / n, 1)).astype(np.int32)
    for k in (np.clip(guess + d, 0, 9) for d in (-1, 0, 1)):
        bits = head + (n - order) * (k + 1) + (residual >> k[:, None]).sum(axis=1)
        better = (bits < best_bits) & (top >> k <= MAX_UNARY)
        best_bits[better], rice[better] = bits[better], k[better]
    verbatim = (best_bits + 10 >= 8 * n) | (best_bits == np.iinfo(np.int64).max)
    kind[verbatim] = -1
    constant = (x == x[:, :1]).all(axis=1, where=inside)
    kind[constant] = -2
    order = np.select([kind == 100, kind >= 0], [LPC_ORDER, kind], 0)

    odd = n != BLOCK  # such a frame states its size in 16 bits
    header = 4 + _utf8_size(number) + 2 * odd + 1
    body = 8 + np.select([kind == -1, kind == -2], [8 * n, 8], best_bits + 10)
    frame_size = header + (body + 7) // 8 + 2
    start = np.cumsum(frame_size) - frame_size
    bits = _Bits(int(frame_size.sum()))

    at = start * 8

    def field(lanes: np.ndarray, value: np.ndarray | int, width: np.ndarray | int) -> None:
        at[lanes] += width
        bits.put(at[lanes], np.broadcast_to(np.asarray(value), lanes.shape), apart=True)

    field(frames, 0xFFF8, 16)
    field(frames, np.where(odd, 7, BLOCK_CODES[BLOCK]) << 4 | 4, 8)
    field(frames, 0x02, 8)
    width = _utf8_size(number)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[width]
    field(frames, lead | (number >> (6 * (width - 1))), 8)
    for i in range(1, 6):
        lanes = np.flatnonzero(width > i)
        field(lanes, 0x80 | ((number[lanes] >> (6 * (width[lanes] - 1 - i))) & 63), 8)
    lanes = np.flatnonzero(odd)
    field(lanes, n[lanes] - 1, 16)
    head_end = at // 8
    at += 8  # for the CRC-8
    field(frames, np.select([kind == -1, kind == -2, kind == 100], [1, 0, 0x20 | (LPC_ORDER - 1)], 8 | order) << 1, 8)
    lanes = np.flatnonzero(kind == -2)
    field(lanes, x[lanes, 0] & 255, 8)
    lanes = np.flatnonzero(kind == -1)
    if lanes.size:
        mask = inside[lanes]
        bits.put((at[lanes][:, None] + 8 * (column + 1))[mask], (x[lanes] & 255)[mask])
        at[lanes] += 8 * n[lanes]
    for i in range(LPC_ORDER):
        lanes = np.flatnonzero((kind >= 0) & (order > i))
        field(lanes, x[lanes, i] & 255, 8)
    lanes = np.flatnonzero(kind == 100)
    field(lanes, (LPC_PRECISION - 1) << 5 | LPC_SHIFT, 9)
    for i in range(LPC_ORDER):
        field(lanes, coefs[lanes, i] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    lanes = np.flatnonzero(kind >= 0)
    field(lanes, rice[lanes], 10)  # method 0, one partition, its parameter
    if lanes.size:
        k, u = rice[lanes][:, None], residual[lanes]
        mask = inside[lanes] & (column >= order[lanes][:, None])
        ends = at[lanes][:, None] + np.cumsum(np.where(mask, (u >> k) + 1 + k, 0), axis=1)
        bits.put(ends[mask], ((1 << k) | (u & ((1 << k) - 1)))[mask])
    out = bits.bytes()
    out[head_end] = _crc(out, start, head_end - start, wide=False)
    crc = _crc(out, start, frame_size - 2, wide=True)
    out[start + frame_size - 2], out[start + frame_size - 1] = crc >> 8, crc & 255

    media = []
    whole, signed = out.tobytes(), (raw ^ 0x80).tobytes()
    sample = 0
    for s, size in enumerate(sizes.tolist()):
        a, b = int(first[s]), int(first[s + 1])
        lo = int(start[a])
        points = np.zeros(b - a, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = number[a:b] * BLOCK, start[a:b] - lo, n[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + b"".join(int(v).to_bytes(3, "big") for v in (frame_size[a:b].min(), frame_size[a:b].max()))
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | size).to_bytes(8, "big") + hashlib.md5(signed[sample : sample + size]).digest()
        table = points.tobytes()
        media.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + whole[lo : int(start[b - 1] + frame_size[b - 1])])
        sample += size
    return media


@dataclass
class Stream:
    """Decoded samples, and where its blocks begin in them."""

    pcm: bytes
    offsets: list[int]


class _Reader:
    """A bit cursor for every lane, over one shared buffer."""

    def __init__(self, data: np.ndarray):
        pad = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        words = np.zeros(data.size + 8, dtype=np.uint64)
        for i in range(8):
            words |= pad[i : i + words.size].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.words = words

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits from position ``at``."""
        return (self.words[np.minimum(at >> 3, self.words.size - 1)] << (at & 7).astype(np.uint64)) >> np.uint64(32)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """``width`` bits (0 to 32) from position ``at``, which moves on."""
        got = (self.window(at) >> (32 - np.asarray(width)).astype(np.uint64)).astype(np.int64)
        at += width
        return got

    def unary(self, at: np.ndarray) -> np.ndarray:
        total = np.zeros(at.size, dtype=np.int64)
        w = self.window(at)
        while (none := w == 0).any():
            if (at[none] >> 3 >= self.words.size).any():
                raise ValueError("FLAC: a code runs past the end")
            total[none] += 32
            at[none] += 32
            w = np.where(none, self.window(at), w)
        zeros = 32 - np.frexp(w.astype(np.float64))[1].astype(np.int64)
        at += zeros + 1
        return total + zeros


def _signed(value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    half = np.left_shift(1, np.maximum(np.asarray(width) - 1, 0))
    return np.where(np.asarray(width) > 0, (value ^ half) - half, 0)


def decode(media: list[bytes]) -> list[Stream]:
    """The samples of every stream; raises ValueError where a check fails."""
    if not media:
        return []
    data = np.frombuffer(b"".join(media), dtype=np.uint8)
    begin = np.cumsum([0, *map(len, media)])
    start, want, streams, number, totals, sums = [], [], [], [], [], []
    for s, m in enumerate(media):
        if m[:4] != b"fLaC":
            raise ValueError("FLAC: no marker")
        at, last, points = 4, False, None
        while not last:
            last, block, size = bool(m[at] & 128), m[at] & 127, int.from_bytes(m[at + 1 : at + 4], "big")
            content = m[at + 4 : at + 4 + size]
            if block == 0:
                packed = int.from_bytes(content[10:18], "big")
                if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                    raise ValueError("FLAC: not mono with 8 bits")
                totals.append(packed & ((1 << 36) - 1))
                sums.append(content[18:34])
            elif block == 3:
                points = np.frombuffer(content, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            at += 4 + size
        if points is None or int(points["n"].sum()) != totals[-1]:
            raise ValueError("FLAC: the seek table doesn't cover the stream")
        start.append(points["offset"].astype(np.int64) + begin[s] + at)
        want.append(points["n"].astype(np.int64))
        streams.append(np.full(len(points), s))
        number.append(np.arange(len(points)))
    per = np.array([len(v) for v in start])
    start, want, streams, number = (np.concatenate(v) for v in (start, want, streams, number))
    end = np.append(start[1:], begin[-1])
    final = np.cumsum(per) - 1
    end[final] = begin[1:]

    order = np.argsort(-want, kind="stable")
    start, end, want, number = start[order], end[order], want[order], number[order]
    reader = _Reader(data)
    at = start * 8
    if (reader.take(at, 16) != 0xFFF8).any():
        raise ValueError("FLAC: no frame where the seek table says")
    code = reader.take(at, 8) >> 4
    if (reader.take(at, 8) & 0xF0).any():
        raise ValueError("FLAC: not mono")
    lead = reader.take(at, 8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    told = lead & np.array([0x7F, 0x1F, 0x0F, 0x07, 0x03, 0x01])[more]
    for i in range(5):
        lanes = np.flatnonzero(more > i)
        cursor = at[lanes]
        told[lanes] = told[lanes] << 6 | (reader.take(cursor, 8) & 63)
        at[lanes] = cursor
    n = _CODE_BLOCKS[code]
    for wide, width in ((6, 8), (7, 16)):
        lanes = np.flatnonzero(code == wide)
        cursor = at[lanes]
        n[lanes] = reader.take(cursor, width) + 1
        at[lanes] = cursor
    if (n != want).any() or (told != number).any():
        raise ValueError("FLAC: a frame's size or number is wrong")
    head = at // 8 - start
    if (reader.take(at, 8) != _crc(data, start, head, wide=False)).any():
        raise ValueError("FLAC: wrong CRC-8")
    crc = data[end - 2].astype(np.int64) << 8 | data[end - 1]
    if (crc != _crc(data, start, end - start - 2, wide=True)).any():
        raise ValueError("FLAC: wrong CRC-16")

    sub = (reader.take(at, 8) >> 1) & 63
    is_fixed, is_lpc, verbatim, constant = (sub >= 8) & (sub <= 12), sub >= 32, sub == 1, sub == 0
    if not (is_fixed | is_lpc | verbatim | constant).all():
        raise ValueError("FLAC: unknown subframe")
    degree = np.select([is_fixed, is_lpc, verbatim], [sub - 8, (sub & 31) + 1, n], 1)
    deepest = int(degree[is_fixed | is_lpc].max(initial=0))
    width = int(n.max(initial=0))
    x = np.zeros((width + 1, n.size), dtype=np.int64)  # by sample, so that a step is one row
    active = np.searchsorted(-n, -np.arange(width), side="left")
    same = np.flatnonzero(constant)
    cursor = at[same]
    x[:, same] = _signed(reader.take(cursor, 8), 8)
    # warm-up samples, and all samples of verbatim frames
    coded = is_fixed | is_lpc
    for i in range(int(np.where(constant, 0, degree).max(initial=0))):
        lanes = np.flatnonzero(~constant & (degree > i))
        cursor = at[lanes]
        x[i, lanes] = _signed(reader.take(cursor, 8), 8)
        at[lanes] = cursor
    coef = np.zeros((max(deepest, len(FIXED) - 1), n.size), dtype=np.int64)
    shift = np.zeros(n.size, dtype=np.int64)
    for one, taps in FIXED.items():
        for i, c in enumerate(taps):
            coef[i, is_fixed & (degree == one)] = c
    lanes = np.flatnonzero(is_lpc)
    if lanes.size:
        cursor = at[lanes]
        precision = reader.take(cursor, 4) + 1
        shift[lanes] = reader.take(cursor, 5)
        for i in range(deepest):
            inner = np.flatnonzero(degree[lanes] > i)
            own = cursor[inner]
            coef[i, lanes[inner]] = _signed(reader.take(own, precision[inner]), precision[inner])
            cursor[inner] = own
        at[lanes] = cursor

    # residuals, in lockstep over the coded lanes
    lanes = np.flatnonzero(coded)
    if lanes.size:
        cursor, deg, size = at[lanes], degree[lanes], n[lanes]
        method = reader.take(cursor, 2)
        if (method > 1).any():
            raise ValueError("FLAC: unknown residual coding")
        parts = size >> reader.take(cursor, 4)
        bits, escape = 4 + method, (16 << method) - 1
        k, plain = np.zeros(lanes.size, dtype=np.int64), np.full(lanes.size, -1)
        taps, moves = coef[:, lanes], shift[lanes]
        y = np.ascontiguousarray(x[:, lanes])
        live = np.searchsorted(-size, -np.arange(width), side="left")
        all_started = int(deg.max())
        even = parts == size  # one partition: its parameter is read once
        for i in range(int(deg.min()), width):
            m = int(live[i])
            if i <= all_started or not even[:m].all():
                new = np.flatnonzero((deg[:m] == i) | ((deg[:m] < i) & (i % parts[:m] == 0)))
                if new.size:
                    own = cursor[new]
                    k[new] = reader.take(own, bits[new])
                    odd = k[new] == escape[new]
                    plain[new] = -1
                    if odd.any():
                        inner = own[odd]
                        plain[new[odd]] = reader.take(inner, 5)
                        own[odd] = inner
                    cursor[new] = own
            go = slice(0, m) if i >= all_started else np.flatnonzero(deg[:m] <= i)
            own, kk, pp = cursor[go].copy(), k[go], plain[go]
            raw = pp >= 0
            if raw.any():
                e = np.zeros(own.size, dtype=np.int64)
                a = own[raw]
                e[raw] = _signed(reader.take(a, pp[raw]), pp[raw])
                own[raw] = a
                b, kb = own[~raw], kk[~raw]
                u = reader.unary(b) << kb
                u |= reader.take(b, kb)
                e[~raw] = (u >> 1) ^ -(u & 1)
                own[~raw] = b
            else:
                u = reader.unary(own) << kk
                u |= reader.take(own, kk)
                e = (u >> 1) ^ -(u & 1)
            cursor[go] = own
            p = np.zeros(e.size, dtype=np.int64)
            for j in range(min(deepest, i)):
                p += taps[j, go] * y[i - 1 - j, go]
            y[i, go] = e + (p >> moves[go])
        x[:, lanes] = y
    if (x < -128).any() or (x > 127).any():
        raise ValueError("FLAC: a sample is out of range")
    back = np.empty_like(order)
    back[order] = np.arange(order.size)
    n, x = n[back], x[:width].T[back]
    flat = (x[np.arange(width) < n[:, None]] & 255).astype(np.uint8)
    out, sample, frame = [], 0, 0
    for s, size in enumerate(totals):
        signed = flat[sample : sample + size]
        if any(sums[s]) and hashlib.md5(signed.tobytes()).digest() != sums[s]:
            raise ValueError("FLAC: wrong MD5")
        sizes = n[frame : frame + per[s]]
        out.append(Stream((signed ^ 0x80).tobytes(), (np.cumsum(sizes) - sizes).tolist()))
        sample, frame = sample + size, frame + int(per[s])
    return out
