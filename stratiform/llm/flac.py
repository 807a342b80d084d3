"""FLAC columns: lossless storage of 8-bit samples, decoding, checksums and seekable PCM blocks.

Numpy code works on all frames of a batch of streams at once, one sample position at a time: a frame is a row, the
bit position of its next Rice code a number, and the prediction a dot product with its last samples. The decoder
reads constant, verbatim, fixed and linear-prediction subframes, both Rice methods with partitions and escapes,
wasted bits, one to eight channels and the three stereo modes; it verifies the CRC-8 of each frame header, the
CRC-16 of each frame, the MD5 of the samples and the places of seek points. The encoder writes mono streams of 8-bit samples, each block by the
best of the five fixed predictors and a linear predictor of order `LPC_ORDER`, with a seek table.

Defined results: a null content is the empty one; a stream of no samples has no frames; a damaged stream gives no
PCM blocks but one row with `error`; equal contents give equal streams; repeated rows give repeated results. A very long
content is worked on in blocks of frames, and takes about fifteen times its size in memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import slices, utf8

BLOCK = 256
#: Frames from one seek point to the next.
SEEK_FRAMES = 16
LPC_ORDER, LPC_BITS = 4, 10
RATE = 44_100
#: Bytes of texts that are encoded or decoded together, and bytes of a longer text whose frames are. The latter is larger, so that short
#: texts together are one block, whatever their last frames add.
BATCH_BYTES, FRAME_BYTES = 400_000, 1_600_000
#: Samples whose bytes are made at a time.
PCM_SAMPLES = 1 << 20

# Fixed values of the format.
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
PLACEHOLDER = 2**64 - 1
DEPTH_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _table(polynomial: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ polynomial if crc & top else crc << 1) & ((1 << bits) - 1)
        out.append(crc)
    return np.array(out, np.int32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of data[start:end] for each pair; the longest go first, so that the rows at work are a prefix."""
    order = np.argsort(starts - ends, kind="stable")
    at, lengths = starts[order], (ends - starts)[order]
    crc, mask = np.zeros(len(at), np.int32), (1 << bits) - 1
    left = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    for k, n in enumerate(left.tolist()):
        byte = data[at[:n] + k]
        crc[:n] = ((crc[:n] << 8) & mask) ^ table[(crc[:n] >> (bits - 8)) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8 (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 * k + 6 - k) or k == 6)
    return bytes([(0xFF00 >> more + 1 & 0xFF) | n >> 6 * more] + [0x80 | n >> 6 * k & 0x3F for k in reversed(range(more))])


# ---------------------------------------------------------------- encoder


def _linear(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients, shift) of the linear predictor of each row, by Levinson-Durbin."""
    rows, p = len(x), LPC_ORDER
    wide = x.astype(np.float64)
    r = np.stack([(wide[:, k:] * wide[:, : BLOCK - k]).sum(1) for k in range(p + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, error = np.zeros((rows, p)), r[:, 0].copy()
    for i in range(p):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        before = a[:, :i].copy()
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << LPC_BITS - 1) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _frames(data: np.ndarray, starts: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the frames of the blocks data[start:start+n]; n is a multiple of 64."""
    rows, t = len(starts), np.arange(BLOCK)
    inside = t[None] < n[:, None]
    x = np.where(inside, data[np.minimum(starts[:, None] + t, len(data) - 1)].astype(np.int32) - 128, 0)
    # The residuals of each predictor; the samples before its order stay as they are.
    residuals, difference = [x], x
    for order in range(1, 5):
        difference = np.concatenate([difference[:, :1] * 0, np.diff(difference, axis=1)], 1)
        residuals.append(np.where(t < order, x, difference))
    coefficients, shift = _linear(x, n)
    predicted = np.zeros((rows, BLOCK), np.int64)
    for j in range(LPC_ORDER):
        predicted[:, j + 1 :] += coefficients[:, j : j + 1] * x[:, : BLOCK - j - 1]
    residuals.append(np.where(t < LPC_ORDER, x, x - (predicted >> shift[:, None]).astype(np.int32)))
    late = inside & (t >= 4)
    weight = np.stack([np.abs(r, where=late, out=np.zeros_like(r)).sum(1, dtype=np.int64) for r in residuals], 1)
    weight[:, 5] += n // 4  # what the coefficients take
    choice = weight.argmin(1)
    order = np.where(choice == 5, LPC_ORDER, choice)
    residual = np.stack(residuals)[choice, np.arange(rows)]
    warm = t[None] < order[:, None]
    # Four Rice partitions, each with its own parameter.
    folded = np.where(inside & ~warm, (residual << 1) ^ (residual >> 31), 0)
    part = np.minimum(t[None] * 4 // n[:, None], 3)
    sums = np.zeros((rows, 4), np.int64)
    for j in range(4):
        sums[:, j] = np.where(part == j, folded, 0).sum(1)
    counts = np.maximum((n // 4)[:, None] - np.where(np.arange(4) == 0, order[:, None], 0), 1)
    k = sum((sums * 2 > (counts * 3) << j).astype(np.int64) for j in range(14))
    rice = np.take_along_axis(k, part, 1)
    quotient = np.where(warm, 0, folded >> rice)
    widths = np.where(inside, np.where(warm, 8, quotient + 1 + rice), 0)
    ahead = np.zeros((rows, BLOCK), np.int64)
    parameters = np.where(choice == 5, 9 + LPC_ORDER * LPC_BITS, 0)
    row = np.arange(rows)
    ahead[row, order] += parameters + 6
    for j in range(4):
        ahead[row, np.where(j == 0, order, j * n // 4)] += 4
    # Headers, then the places of all fields.
    heads = [b"\xff\xf8" + bytes([0x89 if m == BLOCK else 0x69, 0x02]) + _coded_number(i) + (b"" if m == BLOCK else bytes([m - 1])) for m, i in zip(n.tolist(), numbers.tolist(), strict=True)]
    head_sizes = np.array([len(h) + 1 for h in heads])
    body = (widths + ahead).sum(1) + 8
    sizes = head_sizes + (body + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = (offsets[:-1] + head_sizes) * 8
    places = (first + 8)[:, None] + np.cumsum(widths + ahead, 1) - widths
    bits = np.zeros(int(offsets[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = value >> width - 1 - b & 1

    put(first, np.where(choice == 5, 0x40 | LPC_ORDER - 1 << 1, 0x10 | choice << 1), 8)
    coded = inside & ~warm
    at, value, width = places[coded] + quotient[coded], folded[coded], rice[coded]
    bits[at] = 1
    for b in range(int(width.max(initial=0))):
        some = width > b
        bits[at[some] + 1 + b] = value[some] >> width[some] - 1 - b & 1
    put(places[warm & inside], x[warm & inside] & 0xFF, 8)
    linear = choice == 5
    at = places[row, order] - 10
    put(at, np.full(rows, 2), 6)  # Rice method 0, partition order 2
    at = (at - parameters)[linear]
    put(at, np.full(len(at), LPC_BITS - 1), 4)
    put(at + 4, shift[linear], 5)
    for j in range(LPC_ORDER):
        put(at + 9 + j * LPC_BITS, coefficients[linear, j] & (1 << LPC_BITS) - 1, LPC_BITS)
    for j in range(4):
        put(places[row, np.where(j == 0, order, j * n // 4)] - 4, k[:, j], 4)
    out = np.packbits(bits)
    head = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(head_sizes - 1)[:-1]]), head_sizes - 1) + np.arange(len(head))
    out[head_at] = head
    out[offsets[:-1] + head_sizes - 1] = _crc(out, offsets[:-1], offsets[:-1] + head_sizes - 1, CRC8, 8)
    check = _crc(out, offsets[:-1], offsets[1:] - 2, CRC16, 16)
    out[offsets[1:] - 2], out[offsets[1:] - 1] = check >> 8, check & 0xFF
    return out, offsets


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stream of each content data[offsets[i]:offsets[i+1]], whose size is a multiple of 64."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), per)
    numbers = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    starts = offsets[:-1][owner] + numbers * BLOCK
    n = np.minimum(BLOCK, offsets[1:][owner] - starts)
    # Frames do not depend on each other, so those of a long content are made in blocks.
    step, coded, frame_sizes = FRAME_BYTES // BLOCK, [], [np.zeros(0, np.int64)]
    for f in range(0, len(owner), step):
        block, at = _frames(data, starts[f : f + step], n[f : f + step], numbers[f : f + step])
        coded.append(block.tobytes())
        frame_sizes.append(np.diff(at))
    frame_sizes, raw, out, f = np.concatenate(frame_sizes), b"".join(coded), [], 0
    at = np.append(0, np.cumsum(frame_sizes))
    signed = (data ^ 0x80).tobytes()
    for i, count in enumerate(per.tolist()):
        own, begin = frame_sizes[f : f + count], int(at[f])
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        points = range(0, count, SEEK_FRAMES)
        seek = b"".join((j * BLOCK).to_bytes(8, "big") + (int(at[f + j]) - begin).to_bytes(8, "big") + int(n[f + j]).to_bytes(2, "big") for j in points)
        block, least, most = (BLOCK, int(own.min()), int(own.max())) if count else (BLOCK, 0, 0)
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | (hi - lo)
        info = block.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed[lo:hi]).digest()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[begin : int(at[f + count])])
        f += count
    return out


# ---------------------------------------------------------------- decoder


class Damaged(ValueError):
    """A stream that breaks the format or fails a checksum."""


class BrokenFrame(Damaged):
    """A frame that fails its checksum or does not end where the next one begins, at byte `after` of the stream."""

    def __init__(self, frame: int, after: int | None):
        super().__init__("a frame fails its checksum")
        self.frame, self.after = frame, after


def _metadata(stream: bytes) -> tuple[int, dict]:
    """(where the frames begin, what the stream says of itself)."""
    if stream[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(stream):
            raise Damaged("cut off in the metadata")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "block": int.from_bytes(body[2:4], "big"), "md5": body[18:34]}
        elif kind == 3:
            seek = [(int.from_bytes(body[j : j + 8], "big"), int.from_bytes(body[j + 8 : j + 16], "big"), int.from_bytes(body[j + 16 : j + 18], "big")) for j in range(0, size, 18)]
        at += 4 + size
    if info is None:
        raise Damaged("no stream information")
    return at, info | {"seek": seek}


class _Bits:
    """Random access to the bits of a buffer, by arrays of positions."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(data)
        self.words = sum((padded[j : n + j + 1] << np.uint64(8 * (4 - j)) for j in range(5)), np.zeros(n + 1, np.uint64)).view(np.int64)
        ones = np.unpackbits(data)
        self.end = len(ones)
        places = np.where(ones, np.arange(self.end, dtype=np.int32), np.int32(self.end))
        self.next = np.append(np.minimum.accumulate(places[::-1])[::-1], np.int32(self.end))

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        at = np.minimum(at, self.end)
        return self.words[at >> 3] >> (40 - (at & 7) - width) & ((np.int64(1) << width) - 1)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.read(at, width)
        half = np.where(np.asarray(width) > 0, np.int64(1) << np.maximum(np.asarray(width) - 1, 0), 0)
        return value - ((value & half) << 1)


def _headers(data: np.ndarray, starts: list[int], ends: list[int], infos: list[dict], skip: frozenset[int]) -> list[list[tuple]]:
    """For each stream the frames found: (start, number or first sample, block size, channel code, depth, body's first byte).

    Candidates are sync codes whose header passes its CRC-8; the number that a header carries must be the next.
    """
    sync = np.flatnonzero((data[:-1] == 0xFF) & ((data[1:] & 0xFE) == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    owner = np.searchsorted(np.asarray(starts), sync, "right") - 1
    found: list[list[tuple]] = [[] for _ in starts]
    for p, i in zip(sync.tolist(), owner.tolist(), strict=True):
        if i < 0 or p + 6 > ends[i] or p in skip:
            continue
        b = data[p : min(p + 16, ends[i])].tobytes()
        variable, size_code, rate_code, channel, depth_code = b[1] & 1, b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
        if not size_code or rate_code == 15 or channel > 10 or b[3] & 1 or depth_code == 3:
            continue
        lead = b[4]
        more = 0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length() - 1
        if more < 0 or lead in range(0x80, 0xC0) or lead == 0xFF or len(b) < 8 + more - 1 or any(c & 0xC0 != 0x80 for c in b[5 : 5 + more]):
            continue
        number = lead if not more else lead & (0x3F >> more)
        for c in b[5 : 5 + more]:
            number = number << 6 | c & 0x3F
        q = 5 + more
        if size_code in (6, 7):
            size = int.from_bytes(b[q : q + size_code - 5], "big") + 1
            q += size_code - 5
        else:
            size = BLOCK_CODES[size_code]
        q += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        crc = 0
        for c in b[:q]:
            crc = int(CRC8[crc ^ c])
        if q >= len(b) or crc != b[q]:
            continue
        seen = found[i]
        expected = 0 if not seen else seen[-1][1] + (seen[-1][2] if variable else 1)
        if number == expected:
            seen.append((p, number, size, channel, DEPTH_CODES.get(depth_code, infos[i]["depth"]), p + q + 1))
    return found


def _subframes(bits: _Bits, at: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples by time and row, the bit after each subframe)."""
    rows, longest = len(at), int(n.max())
    kind, wasted = bits.read(at + 1, 6), bits.read(at + 7, 1)
    at = at + 8
    run = bits.next[np.minimum(at, bits.end)] - at
    at, wasted = np.where(wasted == 1, at + run + 1, at), np.where(wasted == 1, run + 1, 0)
    depth = depth - wasted
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if ((kind > 1) & ~fixed & ~linear).any():
        raise Damaged("a reserved subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    deep = max(1, int(order.max()))
    s = np.zeros((longest + deep, rows), np.int64)  # `deep` rows of zeros come first
    for j in range(int(order.max())):
        on = order > j
        s[deep + j, on] = bits.signed(at[on] + j * depth[on], depth[on])
    at = at + order * depth
    coefficients, shift = np.zeros((deep, rows), np.int64), np.zeros(rows, np.int64)
    for o in range(1, min(deep, 4) + 1):
        on = fixed & (order == o)
        for j, c in enumerate(FIXED_COEFFICIENTS[o]):
            coefficients[deep - 1 - j, on] = c
    if linear.any():
        precision = bits.read(at, 4) + 1
        shift = np.where(linear, bits.signed(at + 4, 5), 0)
        for j in range(deep):
            on = linear & (order > j)
            coefficients[deep - 1 - j, on] = bits.signed(at[on] + 9 + j * precision[on], precision[on])
        at = np.where(linear, at + 9 + order * precision, at)
    constant, verbatim, coded = kind == 0, kind == 1, fixed | linear
    if constant.any():
        s[deep:, constant] = bits.signed(at[constant], depth[constant])
        at = np.where(constant, at + depth, at)
    for t in range(int(n[verbatim].max(initial=0))):
        on = verbatim & (t < n)
        s[deep + t, on] = bits.signed(at[on], depth[on])
        at[on] += depth[on]
    if coded.any():
        pick = np.flatnonzero(coded)
        a, on_n, o, c, sh = at[pick], n[pick], order[pick], coefficients[:, pick], shift[pick]
        own = s[:, pick]
        method, parts = bits.read(a, 2), bits.read(a + 2, 4)
        if (method > 1).any():
            raise Damaged("a reserved residual code")
        a = a + 6
        parameter_bits, part = 4 + method, on_n >> parts
        if ((part << parts != on_n) | (part <= o)).any():
            raise Damaged("partitions that do not fit the block")
        k, escape, raw = np.zeros(len(a), np.int64), np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        top = (1 << parameter_bits) - 1
        left = o.copy()  # samples until the next parameter
        any_escape = False
        for t in range(longest):
            begins = (t == o) | ((t > o) & (t % part == 0)) if t else o == 0
            begins &= t < on_n
            if begins.any():
                k = np.where(begins, bits.read(a, parameter_bits), k)
                a = np.where(begins, a + parameter_bits, a)
                gone = begins & (k == top)
                escape = np.where(begins, gone, escape)
                if gone.any():
                    raw = np.where(gone, bits.read(a, 5), raw)
                    a = np.where(gone, a + 5, a)
                any_escape = bool(escape.any())
            active = (t >= o) & (t < on_n)
            here = np.minimum(a, bits.end)
            stop = bits.next[here].astype(np.int64) + 1
            folded = (stop - 1 - here << k) | bits.read(stop, k)
            value = (folded >> 1) ^ -(folded & 1)
            after = stop + k
            if any_escape:
                value, after = np.where(escape, bits.signed(a, raw), value), np.where(escape, a + raw, after)
            value += (c * own[t : t + deep]).sum(0) >> sh
            if active.all():
                own[deep + t], a = value, after
            else:
                own[deep + t] = np.where(active, value, own[deep + t])
                a = np.where(active, after, a)
        del left
        s[:, pick], at[pick] = own, a
    return s[deep:] << wasted, at


def decode(streams: list[bytes]) -> list[dict | Damaged]:
    """For each stream its information with `pcm` (samples by channel, whole numbers) and `frames`; a damaged one gives its error.

    `frames` holds (first sample, byte offset from the first frame, samples) of each frame. Streams are decoded
    together; where that fails, each half for itself, so that damage stays with its stream.
    """
    try:
        out = _decode(streams)
    except (Damaged, ArithmeticError, IndexError, MemoryError, ValueError) as why:
        if len(streams) == 1:
            return [why if isinstance(why, Damaged) else Damaged(f"the stream can't be read: {why}")]
        half = len(streams) // 2
        return decode(streams[:half]) + decode(streams[half:])
    return [_again(stream, got) if isinstance(got, BrokenFrame) else got for stream, got in zip(streams, out, strict=True)]


def _again(stream: bytes, why: BrokenFrame) -> dict | Damaged:
    """A frame may hold bytes that look like the next frame's header: it is read again without them."""
    skip: frozenset[int] = frozenset()
    while why.after is not None:
        skip |= {why.after}
        try:
            got = _decode([stream], skip)[0]
        except (Damaged, ArithmeticError, IndexError, MemoryError, ValueError):
            return why
        if not isinstance(got, BrokenFrame) or got.frame <= why.frame:
            return why if isinstance(got, BrokenFrame) else got
        why = got
    return why


def _broken(data: np.ndarray, found: list[list[tuple]], ends: list[int]) -> dict[int, BrokenFrame]:
    """The streams of which a frame fails its CRC-16, with the first that does."""
    flat = [(i, j, f[0], own[j + 1][0] if j + 1 < len(own) else ends[i]) for i, own in enumerate(found) for j, f in enumerate(own)]
    if not flat:
        return {}
    owner, frame, begin, until = (np.array(c, np.int64) for c in zip(*flat, strict=True))
    start = np.concatenate([[0], ends])[owner]
    whole = (_crc(data, begin, until - 2, CRC16, 16) == (data[until - 2].astype(np.int32) << 8 | data[until - 1])) & (until - begin > 8)
    bad = np.flatnonzero(~whole)[::-1].tolist()
    return {int(owner[k]): BrokenFrame(int(frame[k]), int(until[k] - start[k]) if until[k] < ends[owner[k]] else None) for k in bad}


def _samples(data, begin, until, n, channel, channels, depth, body, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(whether each frame ends where it must, the samples of each of `most` channels) of neighbouring frames, from their part of
    the data alone."""
    first = int(begin[0])
    bits, at, samples = _Bits(data[first : int(until[-1])]), (body - first) * 8, []
    for c in range(int(channels.max())):
        on = channels > c
        side = ((channel == 8) & (c == 1)) | ((channel == 9) & (c == 0)) | ((channel == 10) & (c == 1))
        x, after = _subframes(bits, at[on], n[on], (depth + side)[on])
        wide = np.zeros((int(n.max()), len(n)), np.int64)
        wide[: len(x), on] = x
        samples.append(wide)
        at = at.copy()
        at[on] = after
    if len(samples) > 1:
        left, right = samples[0], samples[1]
        middle = (left << 1 | right & 1) + right >> 1
        samples[0] = np.where(channel == 9, left + right, np.where(channel == 10, middle, left))
        samples[1] = np.where(channel == 8, left - right, np.where(channel == 10, middle - right, right))
    valid = (np.arange(int(n.max()))[:, None] < n).T
    small = np.int16 if depth.max() < 16 else np.int32 if depth.max() < 32 else np.int64
    flat = [x.T[valid].astype(small) for x in samples]
    return (at + 7 >> 3) == until - 2 - first, flat + [np.zeros_like(flat[0])] * (most - len(flat))


def pcm_bytes(pcm: list[np.ndarray], depth: int) -> Iterator[bytes]:
    """Samples of all channels, interleaved and little-endian, some at a time."""
    for lo in range(0, len(pcm[0]), PCM_SAMPLES):
        yield np.stack([x[lo : lo + PCM_SAMPLES] for x in pcm], 1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, : -(-depth // 8)].tobytes()


def _decode(streams: list[bytes], skip: frozenset[int] = frozenset()) -> list[dict | Damaged]:
    out: list[dict | Damaged] = []
    starts, infos = [], []
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).tolist()
    for i, stream in enumerate(streams):
        try:
            at, info = _metadata(stream)
        except Damaged as why:
            at, info = len(stream), {"error": why, "channels": 1, "depth": 8, "samples": 0}
        starts.append(base[i] + at)
        infos.append(info)
    data = np.frombuffer(b"".join(streams), np.uint8)
    found = _headers(data, starts, base[1:], infos, skip)
    broken = _broken(data, found, base[1:])
    found = [[] if i in broken else own for i, own in enumerate(found)]
    flat = [(i, *f) for i, own in enumerate(found) for f in own]
    if flat:
        owner, begin, _, n, channel, depth, body = (np.array(c, np.int64) for c in zip(*flat, strict=True))
        # A frame goes up to the next one of its stream.
        until = np.where(np.append(owner[1:], -1) == owner, np.append(begin[1:], 0), np.array(base[1:])[owner])
        channels = np.where(channel < 8, channel + 1, 2)
        parts = [_samples(data, *(c[lo:hi] for c in (begin, until, n, channel, channels, depth, body)), int(channels.max())) for lo, hi in slices(np.append(begin, until[-1]), FRAME_BYTES)]
        whole = np.concatenate([w for w, _ in parts])
        samples = [np.concatenate([x[c] for _, x in parts]) for c in range(int(channels.max()))]
        firsts_of = np.append(0, np.cumsum(n))
        del parts
    k = 0
    for i, (info, own) in enumerate(zip(infos, found, strict=True)):
        rows = slice(k, k + len(own))
        k += len(own)
        if "error" in info:
            out.append(info["error"])
            continue
        if i in broken:
            out.append(broken[i])
            continue
        if own and not whole[rows].all():
            bad = int(np.flatnonzero(~whole[rows])[0])
            out.append(BrokenFrame(bad, own[bad + 1][0] - base[i] if bad + 1 < len(own) else None))
            continue
        if own and info["channels"] > len(samples):
            out.append(Damaged("frames without some of the channels"))
            continue
        pcm = [x[firsts_of[rows.start] : firsts_of[rows.stop]] for x in samples[: info["channels"]]] if own else [np.zeros(0, np.int64)] * info["channels"]
        if len(pcm[0]) != info["samples"]:
            out.append(Damaged(f"{len(pcm[0])} samples of {info['samples']}"))
            continue
        if any(info["md5"]):
            check = hashlib.md5()
            for raw in pcm_bytes(pcm, info["depth"]):
                check.update(raw)
            if check.digest() != info["md5"]:
                out.append(Damaged("the samples fail their checksum"))
                continue
        sizes = [f[2] for f in own]
        firsts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        places = {(firsts[j], f[0] - starts[i], f[2]) for j, f in enumerate(own)}
        if any(point[0] < PLACEHOLDER and point not in places for point in info["seek"]):
            out.append(Damaged("a seek point is not at a frame"))
            continue
        out.append(info | {"pcm": pcm, "frames": [(firsts[j], f[0] - starts[i], f[2]) for j, f in enumerate(own)]})
    return out


# ---------------------------------------------------------------- operators


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contents with bytes 0 appended up to a positive multiple of 64."""
    sizes = np.diff(offsets)
    full = np.maximum(-(-sizes // 64), 1) * 64
    to = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(to[-1]), np.uint8)
    out[np.repeat(to[:-1] - offsets[:-1], sizes) + np.arange(len(raw))] = raw
    return out, to


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): the UTF-8 text, padded to a positive multiple of 64 bytes, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, BATCH_BYTES):
                sizes = np.diff(offsets[lo : hi + 1])
                media = encode(*padded(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_column(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, block, first_sample, byte_offset, samples, channels, depth, pcm binary, error) for each frame of each stream.

    `byte_offset` counts from the first frame, as seek points do; `pcm` is little-endian, channels interleaved. A
    stream without frames has no rows; a damaged one has one row, with `error`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.null()), ("block", pa.int32()), ("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32()), ("channels", pa.int32()), ("depth", pa.int32()), ("pcm", pa.binary()), ("error", pa.string())])
        for batch in batches:
            media = [m or b"" for m in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(m) for m in media])])
            for lo, hi in slices(at, BATCH_BYTES):
                rows, ids = [], []
                for i, got in enumerate(decode(media[lo:hi]), lo):
                    if isinstance(got, Damaged):
                        ids.append(i)
                        rows.append((None, None, None, None, None, None, None, str(got)))
                        continue
                    wide = -(-got["depth"] // 8)
                    raw = b"".join(pcm_bytes(got["pcm"], got["depth"]))
                    step = wide * got["channels"]
                    for j, (first, offset, n) in enumerate(got["frames"]):
                        ids.append(i)
                        rows.append((j, first, offset, n, got["channels"], got["depth"], raw[first * step : (first + n) * step], None))
                columns = [batch.column(0).take(pa.array(ids, pa.int64()))] + [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)] if rows else []
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(run, f"id {kind}, block int, first_sample long, byte_offset long, samples int, channels int, depth int, pcm binary, error string").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: sizes and hashes of the payload as read back and of its stream, and the features.

    The features are of the decoded samples: frames, sum, sum of squares, least, most, and sign changes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, BATCH_BYTES):
                media = encode(*padded(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                rows = []
                for stored, got in zip(media, decode(media), strict=True):
                    if isinstance(got, Damaged):
                        raise got
                    x = got["pcm"][0]
                    payload = (x + 128).astype(np.uint8).tobytes()
                    signs = np.signbit(x)
                    feature = f"frames={len(got['frames'])};sum={int(x.sum())};squares={int(np.square(x, dtype=np.int32).sum())};least={int(x.min())};most={int(x.max())};crossings={int((signs[1:] != signs[:-1]).sum())}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), *columns], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(F.col("id").alias(id_col), *out.columns[1:])
