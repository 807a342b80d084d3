"""A plain writer of FLAC streams, bit by bit, for what our encoder does not write."""

import hashlib

FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc(data, polynomial, width):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> (width - 1) & 1 else 0)) & (1 << width) - 1
    return value


def bits(value, width):
    return format(value & (1 << width) - 1, f"0{width}b") if width else ""


def residuals(x, coefficients, shift):
    o = len(coefficients)
    return [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift) for i in range(o, len(x))]


def rice(values, order, n, parts, k, method, escape):
    """Residuals in 2^parts partitions with the parameter k; every second partition is escaped if asked for."""
    out, at = bits(method, 2) + bits(parts, 4), 0
    width = 4 + method
    for p in range(1 << parts):
        size = (n >> parts) - (order if p == 0 else 0)
        own = values[at : at + size]
        at += size
        if escape and p % 2 == 0:
            raw = max([max(v, ~v).bit_length() + 1 for v in own], default=0)
            out += "1" * width + bits(raw, 5) + "".join(bits(v, raw) for v in own)
        else:
            folded = [2 * v if v >= 0 else -2 * v - 1 for v in own]
            out += bits(k, width) + "".join("0" * (v >> k) + "1" + bits(v, k) for v in folded)
    return out


def subframe(x, depth, kind, order=0, coefficients=(), shift=0, wasted=0, parts=0, k=3, method=0, escape=False):
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "linear": 31 + order}[kind]
    out = "0" + bits(code, 6) + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
    x, depth = [v >> wasted for v in x], depth - wasted
    if kind == "constant":
        return out + bits(x[0], depth)
    if kind == "verbatim":
        return out + "".join(bits(v, depth) for v in x)
    out += "".join(bits(v, depth) for v in x[:order])
    if kind == "linear":
        out += bits(14, 4) + bits(shift, 5) + "".join(bits(c, 15) for c in coefficients)
    else:
        coefficients, shift = FIXED[order], 0
    return out + rice(residuals(x, coefficients, shift), order, len(x), parts, k, method, escape)


def number(n):
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more) >= 1 << (6 - more):
        more += 1
    return bytes([(0xFF << (7 - more)) & 0xFF | n >> (6 * more), *(0x80 | n >> (6 * i) & 0x3F for i in reversed(range(more)))])


def stream(channels, depth, blocks, assignment, make, variable=False):
    """Channels of samples in blocks of the given sizes; `make(samples, depth, block, channel)` writes a subframe."""
    body, at = b"", 0
    for j, size in enumerate(blocks):
        own = [c[at : at + size] for c in channels]
        depths = [depth] * len(own)
        if assignment == 8:
            own, depths = [own[0], [a - b for a, b in zip(*own, strict=True)]], [depth, depth + 1]
        elif assignment == 9:
            own, depths = [[a - b for a, b in zip(*own, strict=True)], own[1]], [depth + 1, depth]
        elif assignment == 10:
            own, depths = [[a + b >> 1 for a, b in zip(*own, strict=True)], [a - b for a, b in zip(*own, strict=True)]], [depth, depth + 1]
        head = bytes([0xFF, 0xF8 | variable, 0x70, (assignment if len(channels) == 2 and assignment > 7 else len(channels) - 1) << 4]) + number(at if variable else j) + (size - 1).to_bytes(2, "big")
        head += bytes([crc(head, 0x07, 8)])
        text = "".join(make(x, d, j, c) for c, (x, d) in enumerate(zip(own, depths, strict=True)))
        text += "0" * (-len(text) % 8)
        frame = head + int(text, 2).to_bytes(len(text) // 8, "big")
        body += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
        at += size
    wide = -(-depth // 8)
    raw = b"".join((c[i] & (1 << 8 * wide) - 1).to_bytes(wide, "little") for i in range(at) for c in channels)
    info = min(blocks).to_bytes(2, "big") + max(blocks).to_bytes(2, "big") + bytes(6) + (44_100 << 44 | len(channels) - 1 << 41 | depth - 1 << 36 | at).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x80\x00\x00\x22" + info + body
