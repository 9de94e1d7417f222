"""Operator 1: media columns as lossless WebP.

Decoding covers the whole lossless format: prefix codes, back-references, colour cache, meta prefix codes, and the
predictor, cross-colour, subtract-green and palette transforms, in simple and animated containers. Images without
meta prefix codes are decoded many at a time: all streams of a batch advance one symbol a step as arrays.

Bytes are stored four to a pixel (R, G, B, A), 48 pixels to a row. A frame has at most `ROWS` rows; longer payloads are
frames of one animated file, so any length can be stored. The writer uses literals, colour cache and runs with one
Huffman code for green and one for the other channels of each frame, and a transform where that makes a frame shorter.

Null texts count as empty; the payload of an empty text is one row of 192 spaces. Equal texts have equal values.
Repeated rows give repeated results. Extra columns pass through `encoded` and `decoded`; an input column with the name of
an output gives way to it. An empty table gives an empty table. A damaged file fails the job with ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from triplespan.llm import common

WIDTH, ROWS, CACHE_BITS, LONGEST = 48, 32, 7, 11
ROW_BYTES = 4 * WIDTH
BATCH_BYTES = 4 << 20  # of payload that are encoded or decoded at a time

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
BLACK = 0xFF000000
#: Predictors that look at the pixel before only, or only at the row above.
BY_ROWS = (1, 2, 3, 4, 8, 9)

#: (dx, dy) of the 120 short distance codes: neighbours by Euclidean distance, upper ones first, then left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---------------------------------------------------------------- prefix codes


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    """For each number below 2^n, the number with its n bits in reverse."""
    i, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= ((i >> k) & 1) << (n - 1 - k)
    return out


def lookup(lengths: list[int]) -> np.ndarray:
    """Table from the next bits of a stream to symbol * 16 + length, of 2^(longest length) entries."""
    length = np.asarray(lengths)
    used = np.flatnonzero(length)
    if len(used) == 0:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([used[0] << 4], np.int32)
    order = used[np.argsort(length[used], kind="stable")]
    length = length[order]
    most = int(length[-1])
    table = np.repeat((order << 4 | length).astype(np.int32), 1 << (most - length))
    if len(table) != 1 << most:
        raise ValueError("an incomplete or oversubscribed prefix code")
    out = np.empty_like(table)
    out[reversed_bits(most)] = table
    return out


@lru_cache(maxsize=64)
def lookup_of_lengths(lengths: tuple[int, ...]) -> list[int]:
    """`lookup` of a code for code lengths; writers use few of them."""
    return lookup(list(lengths)).tolist()


class Bits:
    """Reads a stream's bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.base, self.window = 0, int.from_bytes(data[:512], "little")

    def peek(self, n: int) -> int:
        at = self.at - self.base
        if at < 0 or at + n > 4096:  # a code is looked at again from its start
            self.base = self.at >> 3 << 3
            self.window = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 512], "little")
            at = self.at - self.base
        return self.window >> at & (1 << n) - 1

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the stream ends early")
        return out

    def symbol(self, table: np.ndarray) -> int:
        e = int(table[self.peek(15) & len(table) - 1])
        self.at += e & 15
        return e >> 4


def prefix_code(bits: Bits, alphabet: int, before: tuple[int, int, int, np.ndarray] | None = None) -> tuple[int, int, int, np.ndarray]:
    """(alphabet, number of bits, the bits, table) of the code at this place. `before`: a code that may be repeated here."""
    start = bits.at
    if before and before[0] == alphabet and before[1] < 2048 and bits.peek(before[1]) == before[2]:
        bits.at += before[1]
        return before
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]:
            lengths[s] = 1
    else:
        order = [0] * 19
        given = CODE_LENGTH_ORDER[: 4 + bits.read(4)]
        three = bits.read(3 * len(given))
        for k, s in enumerate(given):
            order[s] = three >> 3 * k & 7
        table = lookup_of_lengths(tuple(order))
        mask, left = len(table) - 1, alphabet
        if bits.read(1):
            left = 2 + bits.read(2 + 2 * bits.read(3))
        i, last = 0, 8
        window, at = bits.peek(256), 0  # a length takes at most 14 bits
        while i < alphabet and left:
            left -= 1
            if at > 240:
                bits.at += at
                window, at = bits.peek(256), 0
            v = window >> at
            e = table[v & mask]
            at += e & 15
            s = e >> 4
            if s < 16:
                lengths[i] = s
                i += 1
                last = s or last
            else:
                v >>= e & 15
                n, used = (3 + (v & 3), 2) if s == 16 else (3 + (v & 7), 3) if s == 17 else (11 + (v & 127), 7)
                at += used
                if i + n > alphabet:
                    raise ValueError("too many code lengths")
                if s == 16:
                    lengths[i : i + n] = [last] * n
                i += n
        bits.at += at
        if bits.at > 8 * len(bits.data) + 64:
            raise ValueError("the stream ends early")
    n = bits.at - start
    at, bits.at = bits.at, start
    raw = bits.peek(n) if n < 2048 else -1
    bits.at = at
    return alphabet, n, raw, lookup(lengths)


# ---------------------------------------------------------------- one image


def extended(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def plane(code: int, width: int) -> int:
    """Distance in pixels of a distance code."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def codes(bits: Bits, cache_bits: int) -> list[np.ndarray]:
    """Tables of green, red, blue, alpha and distance."""
    out, before = [], None
    for alphabet in (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES):
        before = prefix_code(bits, alphabet, before)
        out.append(before[3])
    return out


def cache_size(bits: Bits) -> int:
    if not bits.read(1):
        return 0
    n = bits.read(4)
    if not 1 <= n <= 11:
        raise ValueError("bad colour cache size")
    return n


def pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels (ARGB in one number) of one entropy-coded image, one symbol at a time."""
    cache_bits = cache_size(bits)
    block, groups, group_of = 0, None, None
    if top and bits.read(1):
        block = bits.read(3) + 2
        wide = -(-width >> block)
        group_of = (pixels(bits, wide, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
        groups = [codes(bits, cache_bits) for _ in range(max(group_of) + 1)]
    else:
        groups = [codes(bits, cache_bits)]
    out, total, i = [0] * (width * height), width * height, 0
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    while i < total:
        green, red, blue, alpha, far = groups[group_of[(i // width >> block) * wide + (i % width >> block)] if group_of else 0]
        s = bits.symbol(green)
        start = i
        if s < 256:
            r, b = bits.symbol(red), bits.symbol(blue)
            out[i] = bits.symbol(alpha) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTHS:
            n = extended(bits, s - 256)
            back = plane(extended(bits, bits.symbol(far)), width)
            if back > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[i] = out[i - back]
                i += 1
        else:
            out[i] = cache[s - 256 - LENGTHS]
            i += 1
        if cache_bits:
            for p in out[start:i]:
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = p
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return np.array(out, np.int64)


class Header:
    """What precedes the main image: size and transforms; `width` is that of the main image as it is coded."""

    def __init__(self, bits: Bits):
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless stream")
        self.full, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.width, self.transforms = self.full, []
        while bits.read(1):
            kind = bits.read(2)
            if kind < 2:
                block = bits.read(3) + 2
                data = pixels(bits, -(-self.width >> block), -(-self.height >> block), False)
                self.transforms.append((kind, self.width, block, data))
            elif kind == 2:
                self.transforms.append((kind, self.width, 0, None))
            else:
                n = bits.read(8) + 1
                colours = pixels(bits, n, 1, False)
                data = joined(np.cumsum(channels(colours), axis=0) & 255)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, self.width, pack, data))
                self.width = -(-self.width >> pack)

    def undone(self, image: np.ndarray) -> np.ndarray:
        """The image with all transforms inverted, last one first."""
        for kind, width, block, data in reversed(self.transforms):
            image = (unpredicted, uncrossed, ungreened, unpaletted)[kind](image, width, block, data)
        return image


def channels(image: np.ndarray) -> np.ndarray:
    """Columns A, R, G, B."""
    return np.stack([image >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def joined(c: np.ndarray) -> np.ndarray:
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def blocks(width: int, n: int, block: int, data: np.ndarray) -> np.ndarray:
    """The element of `data` for each of n pixels."""
    i = np.arange(n)
    return data[(i // width >> block) * (-(-width >> block)) + (i % width >> block)]


def ungreened(image: np.ndarray, width: int, block: int, data: None) -> np.ndarray:
    c = channels(image)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return joined(c & 255)


def uncrossed(image: np.ndarray, width: int, block: int, data: np.ndarray) -> np.ndarray:
    signed = lambda x: (x & 255 ^ 128) - 128
    c, (_, red_blue, green_blue, green_red) = channels(image), channels(blocks(width, len(image), block, data)).T
    green = signed(c[:, 2])
    c[:, 1] += signed(green_red) * green >> 5
    c[:, 3] += (signed(green_blue) * green >> 5) + (signed(red_blue) * signed(c[:, 1]) >> 5)
    return joined(c & 255)


def unpaletted(image: np.ndarray, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    packed = -(-width >> pack)
    i = np.arange(len(image) // packed * width)
    x, bits = i % width, 8 >> pack
    at = image[i // width * packed + (x >> pack)] >> 8 & 255
    at = at >> ((x & (1 << pack) - 1) * bits) & (1 << bits) - 1
    return np.where(at < len(colours), colours[np.minimum(at, len(colours) - 1)], 0)


def predicted(mode: int, left, top, right, corner):
    """Prediction of a pixel's channels from L, T, TR and TL."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        p = left + top - corner
        return left if abs(p - left).sum() < abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = half(left, top)
        d = a - corner
        return np.clip(a + (d + (d < 0)) // 2, 0, 255)  # halved towards zero
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner),
        7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode, lambda: channels(np.int64(BLACK)))()


def prediction(out: np.ndarray, i: int, width: int, mode: int):
    """Prediction of pixel i from the channels of those before it."""
    if i < width:
        return predicted(1 if i else 0, out[i - 1], None, None, None)
    if i % width == 0:
        return out[i - width]
    return predicted(mode, out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])


def by_rows(rest: np.ndarray, mode: int) -> np.ndarray:
    """Rows of pixels that one of the modes BY_ROWS predicts, of which none looks further than the row above but 1 at the pixel before."""
    rest[0, 0] += channels(np.int64(BLACK))
    rest[0] = np.cumsum(rest[0], axis=0) & 255
    for above, row in zip(rest, rest[1:], strict=False):
        row[0] = row[0] + above[0] & 255
        right = np.concatenate([above[2:], row[:1]])[: len(row) - 1]
        top, corner = above[1:], above[:-1]
        if mode == 1:
            row[:] = np.cumsum(row, axis=0) & 255
        else:
            row[1:] = row[1:] + predicted(mode, None, top, right, corner) & 255
    return rest


def unpredicted(image: np.ndarray, width: int, block: int, data: np.ndarray) -> np.ndarray:
    out, modes = channels(image), (blocks(width, len(image), block, data) >> 8 & 15).tolist()
    if modes[0] in BY_ROWS and len(set(modes)) == 1:
        return joined(by_rows(out.reshape(-1, width, 4), modes[0]).reshape(-1, 4))
    for i in range(len(out)):
        out[i] = (out[i] + prediction(out, i, width, modes[i])) & 255
    return joined(out)


# ---------------------------------------------------------------- many images in step


def in_step(streams: list[bytes], starts: list[int], sizes: list[tuple[int, int]], cache_bits: list[int], tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Main images without meta prefix codes, all streams one symbol a step. starts: first bit after the codes."""
    lanes = len(streams)
    padded = [s + bytes(-len(s) % 4) for s in streams]
    at_byte = np.cumsum([0, *map(len, padded)])
    half = np.frombuffer(b"".join(padded) + bytes(4096), np.uint16).astype(np.uint64)
    words = half[:-3] | half[1:-2] << np.uint64(16) | half[2:-1] << np.uint64(32) | half[3:] << np.uint64(48)
    words = words.view(np.int64)  # the 64 bits from each second byte on: 49 of them are there from any bit on
    ends = 8 * (at_byte[:-1] + np.array([len(s) for s in streams]))
    seen: dict[int, int] = {}
    flat, n = [], 0
    for code in tables:
        for t in code:
            if id(t) not in seen:
                seen[id(t)] = n
                flat.append(t)
                n += len(t)
    flat = np.concatenate(flat).astype(np.int64)
    once = max((sum(int(len(t)).bit_length() - 1 for t in code[:4]) for code in tables), default=0) <= 49  # one read holds a pixel
    base = np.array([[seen[id(t)] for t in code] for code in tables]).T.copy()
    mask = np.array([[len(t) - 1 for t in code] for code in tables]).T.copy()
    pos = np.array(starts, np.int64) + 8 * at_byte[:-1]
    width, size = np.array([w for w, _ in sizes]), np.array([w * h for w, h in sizes])
    first = np.concatenate([[0], np.cumsum(size + 1)])  # a spare cell after each image
    out = np.zeros(first[-1], np.uint32)
    cache_at = np.concatenate([[0], np.cumsum(1 << np.array(cache_bits))])
    cache, shift = np.zeros(cache_at[-1], np.int64), 32 - np.array(cache_bits)
    lane, x, o, cache_at = np.arange(lanes), np.zeros(lanes, np.int64), first[:-1], cache_at[:-1]
    slots = cache_at - 256 - LENGTHS
    final = np.zeros(lanes, np.int64)
    while len(lane):
        (gb, rb, bb, ab, db), (gm, rm, bm, am, dm) = base, mask
        for _ in range(32):
            v = words[pos >> 4] >> (pos & 15)
            e = flat[gb + (v & gm)]
            used = e & 15
            s = e >> 4
            v >>= used
            er = flat[rb + (v & rm)]
            after = pos + used
            used = er & 15
            to = after + used
            v = v >> used if once else words[to >> 4] >> (to & 15)
            eb = flat[bb + (v & bm)]
            used = eb & 15
            ea = flat[ab + (v >> used & am)]
            to += used
            to += ea & 15
            p = ea >> 4 << 24 | er >> 4 << 16 | s << 8 | eb >> 4
            known = np.flatnonzero(s >= 256 + LENGTHS)
            if len(known):
                to[known] = after[known]
                p[known] = cache[slots[known] + s[known]]
            for i in np.flatnonzero((s >= 256) & (s < 256 + LENGTHS) & (x < size)) if len(known) < np.count_nonzero(s >= 256) else ():
                to[i] = after[i]
                at = int(after[i])

                def extra(prefix: int) -> int:
                    nonlocal at
                    if prefix < 4:
                        return prefix + 1
                    k = (prefix - 2) >> 1
                    got = int(words[at >> 4]) >> (at & 15) & (1 << k) - 1
                    at += k
                    return ((2 + (prefix & 1)) << k) + got + 1

                n = extra(int(s[i]) - 256)
                d = int(flat[db[i] + ((int(words[at >> 4]) >> (at & 15)) & int(dm[i]))])
                at += d & 15
                back, a = plane(extra(d >> 4), int(width[i])), int(o[i] + x[i])
                if back > x[i] or x[i] + n > size[i]:
                    raise ValueError("a back-reference leaves the image")
                copied = np.resize(out[a - back : a - back + min(n, back)], n)
                out[a : a + n] = copied
                copied = copied.astype(np.int64)
                cache[cache_at[i] + ((copied * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift[i])] = copied
                x[i] += n - 1
                p[i], to[i] = copied[-1], at
            out[o + x] = p
            cache[cache_at + ((p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift)] = p
            pos = np.where(x < size, to, pos)
            x = np.minimum(x + 1, size)
        go = x < size
        if not go.all():
            final[lane[~go]] = pos[~go]
            lane, pos, x, size, width, o, cache_at, slots, shift = (y[go] for y in (lane, pos, x, size, width, o, cache_at, slots, shift))
            base, mask = base[:, go], mask[:, go]
        if (pos > ends[lane]).any():
            break
    if len(lane) or (final > ends).any():
        raise ValueError("a stream ends early")
    return [out[a : b - 1].astype(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]


def decode_streams(streams: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, pixels in ARGB) of lossless streams."""
    out: list = [None] * len(streams)
    plain = []
    for k, s in enumerate(streams):
        bits = Bits(s)
        head = Header(bits)
        at = bits.at
        cache_bits = cache_size(bits)
        if bits.read(1):  # meta prefix codes
            bits.at = at
            out[k] = head.full, head.height, head.undone(pixels(bits, head.width, head.height, True))
        else:
            plain.append((k, head, cache_bits, codes(bits, cache_bits), bits.at))
    if plain:
        images = in_step([streams[k] for k, *_ in plain], [x[4] for x in plain], [(x[1].width, x[1].height) for x in plain], [x[2] for x in plain], [x[3] for x in plain])
        for (k, head, *_), image in zip(plain, images, strict=True):
            out[k] = head.full, head.height, head.undone(image)
    return out


# ---------------------------------------------------------------- containers


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)


def container(frames: list[tuple[int, int, bytes]]) -> bytes:
    """One file of (width, height, lossless stream): simple for one frame, else animated."""
    if len(frames) == 1:
        body = chunk(b"VP8L", frames[0][2])
    else:
        three = lambda n: struct.pack("<I", n)[:3]
        w, h = max(f[0] for f in frames), max(f[1] for f in frames)
        body = chunk(b"VP8X", struct.pack("<I", 0x12) + three(w - 1) + three(h - 1)) + chunk(b"ANIM", bytes(6))
        for w, h, s in frames:
            body += chunk(b"ANMF", bytes(6) + three(w - 1) + three(h - 1) + bytes(3) + b"\x02" + chunk(b"VP8L", s))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def streams(file: bytes) -> list[bytes]:
    """The lossless streams of a file, in order."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            n = struct.unpack_from("<I", file, at + 4)[0]
            if at + 8 + n > end:
                raise ValueError("a chunk leaves the file")
            if file[at : at + 4] == b"VP8L":
                out.append(file[at + 8 : at + 8 + n])
            elif file[at : at + 4] == b"ANMF":
                walk(at + 24, at + 8 + n)
            elif file[at : at + 4] == b"VP8 ":
                raise ValueError("a lossy frame")
            at += 8 + n + n % 2

    walk(12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0]))
    return out


def samples(image: np.ndarray) -> bytes:
    """R, G, B, A bytes of ARGB pixels."""
    p = image.astype(np.uint32)
    return (p & np.uint32(0xFF00FF00) | (p & np.uint32(0xFF)) << np.uint32(16) | p >> np.uint32(16) & np.uint32(0xFF)).astype("<u4").tobytes()


def decode_files(files: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """For each file its frames as (width, height, RGBA bytes)."""
    each = [streams(f) for f in files]
    images = iter(decode_streams([s for x in each for s in x]))
    return [[(w, h, samples(p)) for w, h, p in (next(images) for _ in x)] for x in each]


# ---------------------------------------------------------------- writing


def huffman(counts: list[int], longest: int = LONGEST) -> list[int]:
    """Code lengths of at most `longest`; symbols with count 0 get 0, a single symbol 1."""
    return huffman_rows(np.array([counts]), longest)[0].tolist()


def huffman_rows(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of at most `longest` for each row of counts, all rows together; symbols with count 0 get 0, a single symbol 1.

    The two lightest nodes merge, as often as a row has symbols but one. Leaves wait in order of weight and symbol; merged nodes
    have rising weights, and so wait in the order they are made. Of equal weights leaves go first.
    """
    out = np.zeros(counts.shape, np.int64)
    n = np.count_nonzero(counts, axis=1)
    out[n == 1] = counts[n == 1] > 0
    left, weights = np.flatnonzero(n > 1), counts.astype(np.int64)
    while len(left):
        left = left[np.argsort(-n[left], kind="stable")]  # rows with most symbols first: those still at work are the first ones
        most, width = n[left], int(n[left[0]])
        never = np.iinfo(np.int64).max >> 1
        w = weights[left]
        order = np.argsort(np.where(w > 0, w, never), axis=1, kind="stable")[:, :width]
        leaf = np.full((len(left), width + 1), never)
        leaf[:, :width] = np.take_along_axis(w, order, 1)
        leaf[leaf == 0] = never
        node = np.full((len(left), width + 1), never)
        of_leaf, of_node = np.zeros((len(left), width + 1), np.int64), np.zeros((len(left), width + 1), np.int64)
        at_leaf, at_node = np.arange(len(left)) * (width + 1), np.arange(len(left)) * (width + 1)
        flat_leaf, flat_node = leaf.ravel(), node.ravel()
        parent_leaf, parent_node = of_leaf.ravel(), of_node.ravel()
        active = np.searchsorted(-most, -np.arange(width), side="left")  # rows with more than so many symbols
        for step in range(width - 1):
            k = active[step + 1]
            i, j, total = at_leaf[:k], at_node[:k], 0
            for _ in range(2):
                a, b = flat_leaf[i], flat_node[j]
                is_leaf = a <= b
                total = total + np.where(is_leaf, a, b)
                parent_leaf[i[is_leaf]] = step
                parent_node[j[~is_leaf]] = step
                i += is_leaf
                j += ~is_leaf
            node[:k, step] = total
        depth, rows = np.zeros((len(left), width + 1), np.int64), np.arange(len(left))
        for step in range(width - 3, -1, -1):
            k = active[step + 2]  # the last node of a row is its root
            depth[:k, step] = depth[rows[:k], of_node[:k, step]] + 1
        lengths = np.take_along_axis(depth, of_leaf[:, :width], 1) + 1
        lengths[np.arange(width) >= most[:, None]] = 0
        good = lengths.max(axis=1) <= longest
        done = np.zeros((len(left), counts.shape[1]), np.int64)
        np.put_along_axis(done, order, lengths, 1)
        out[left[good]] = done[good]
        left = left[~good]
        weights[left] = (weights[left] + 1) >> 1
    return out


#: A fixed complete code for code lengths: short for long runs of zeros and for lengths that text has.
_OF_LENGTHS = [4, 5, 5, 5, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 0, 4, 2]


def canonical(lengths: list[int]) -> list[int]:
    """Codes as they enter the stream, first bit lowest."""
    return canonical_rows(np.array([lengths]))[0].tolist()


def canonical_rows(lengths: np.ndarray) -> np.ndarray:
    """Codes as they enter the stream, first bit lowest, for each row of lengths; rows have complete codes or none."""
    out = np.zeros(lengths.shape, np.int64)
    row, symbol = np.nonzero(lengths)
    order = np.argsort(row << 4 | lengths[row, symbol], kind="stable")
    row, symbol = row[order], symbol[order]
    share = 1 << (15 - lengths[row, symbol])
    out[row, symbol] = reversed_bits(15)[(np.cumsum(share) - share) & (1 << 15) - 1]  # a complete code has 2^15 shares
    return out


_LENGTH_CODES = canonical(_OF_LENGTHS)
_LENGTH_HEAD = sum(_OF_LENGTHS[s] << 3 * k for k, s in enumerate(CODE_LENGTH_ORDER))


@lru_cache(maxsize=512)
def zeros(n: int) -> tuple[int, int]:
    """(number, bits) of n lengths of zero."""
    value, bits = 0, 0
    while n:
        run = min(n, 138)
        s, extra, width = (18, run - 11, 7) if run >= 11 else (17, run - 3, 3) if run >= 3 else (0, 0, 0)
        value |= (_LENGTH_CODES[s] | extra << _OF_LENGTHS[s]) << bits
        bits += _OF_LENGTHS[s] + width
        n -= run if run >= 3 else 1
    return value, bits


def written_code(lengths: list[int] | np.ndarray) -> tuple[int, int]:
    """(number, bits) of a prefix code's description."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        return 0b101 | (int(used[0]) if len(used) else 0) << 3, 11
    value, n = _LENGTH_HEAD << 5 | 15 << 1, 5 + 57 + 1
    before = -1
    for i, k in zip(used.tolist(), lengths[used].tolist(), strict=True):
        if i > before + 1:
            gap, bits = zeros(i - before - 1)
            value |= gap << n
            n += bits
        value |= _LENGTH_CODES[k] << n
        n += _OF_LENGTHS[k]
        before = i
    gap, bits = zeros(len(lengths) - before - 1)
    return value | gap << n, n + bits


def runs(equal: np.ndarray, free: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of `equal & free` of at least `least`."""
    on = np.concatenate([[False], equal & free, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], (end - start)[long]


def coded(rgba: np.ndarray, sizes: np.ndarray, widths: np.ndarray, before: list[tuple[int, int]]) -> list[bytes]:
    """Streams of images, all of a batch together: pixels one image after the other, their numbers and widths, and what the streams
    begin with (number, bits), sizes and transforms."""
    red, green, blue, alpha = rgba.astype(np.int64).T
    p = alpha << 24 | red << 16 | green << 8 | blue
    total, n_frames = len(p), len(sizes)
    first = np.cumsum(sizes) - sizes
    frame = np.repeat(np.arange(n_frames), sizes)
    place = np.arange(total) - first[frame]
    # back-references to the pixel before (distance code 2) and the one above (code 1)
    free = np.ones(total, bool)
    token = np.ones(total, bool)
    length, code = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for back, which in ((np.ones(n_frames, np.int64), 1), (widths, 0)):
        back = back[frame]
        same = (place >= back) & (p == p[np.maximum(np.arange(total) - back, 0)])
        # a run may pass into the next frame only through a place below `back`, where `same` is false
        start, n = runs(same, free)
        length[start], code[start] = n, which
        inside = np.zeros(total + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, start + n, -1)
        covered = np.cumsum(inside[:-1]) > 0
        free &= ~covered
        token &= ~covered
        token[start] = True
    # colour cache: the last pixel of the frame before with the same slot
    slot = (p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    order = np.argsort(slot.astype(np.uint8), kind="stable")  # by slot, and so by frame within a slot
    hit = np.zeros(total, bool)
    hit[order[1:]] = (frame[order[1:]] == frame[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
    refs = np.flatnonzero(length)
    hit[refs] = False
    # symbols of the green code: literals, lengths, cache slots
    n = length[refs]
    high = np.maximum(0, np.int64(np.floor(np.log2(np.maximum(n - 1, 1)))))
    extra_bits = np.where(n > 4, high - 1, 0)
    prefix = np.where(n > 4, 2 * high + ((n - 1) >> np.maximum(high - 1, 0) & 1), n - 1)
    extra = np.where(n > 4, (n - 1) & (1 << extra_bits) - 1, 0)
    symbol = np.where(hit, 256 + LENGTHS + slot, green)
    symbol[refs] = 256 + prefix
    literal = token & ~hit
    literal[refs] = False
    alphabet = 256 + LENGTHS + (1 << CACHE_BITS)
    at = np.flatnonzero(token)
    of_green = np.bincount(frame[at] * alphabet + symbol[at], minlength=n_frames * alphabet).reshape(n_frames, alphabet)
    lit = np.flatnonzero(literal)
    of_rest = sum(np.bincount(frame[lit] * 256 + c[lit], minlength=n_frames * 256) for c in (red, blue, alpha)).reshape(n_frames, 256)
    # codes and headers
    heads, codes_ = [], []
    of_codes = huffman_rows(of_green), huffman_rows(of_rest)
    for (value, bits), gl, rl in zip(before, *of_codes, strict=True):
        value, bits = value | (1 << 1 | CACHE_BITS << 2) << bits, bits + 7  # no more transforms, cache, no meta codes
        for what, width in (written_code(gl), *[written_code(rl)] * 3, (0b1_0011, 12)):
            value, bits = value | what << bits, bits + width
        heads.append((value, bits))
    for lengths in of_codes:
        lengths[np.count_nonzero(lengths, axis=1) == 1] = 0  # a single symbol takes no bits
        codes_.append(np.stack([canonical_rows(lengths), lengths], axis=-1))
    green_code, rest_code = codes_
    # bits of every token, then of every frame
    value, bits = green_code[frame[at], symbol[at], 0], green_code[frame[at], symbol[at], 1]
    is_lit = literal[at]
    for c in (red, blue, alpha):
        got = rest_code[frame[lit], c[lit]]
        value[is_lit] |= got[:, 0] << bits[is_lit]
        bits[is_lit] += got[:, 1]
    is_ref = np.flatnonzero(length[at])
    value[is_ref] |= (extra | code[refs] << extra_bits) << bits[is_ref]
    bits[is_ref] += extra_bits + 1
    body = np.bincount(frame[at], bits, n_frames).astype(np.int64)
    need = np.array([b for _, b in heads]) + body
    words = (need + 63) // 64 + 1
    word_at = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    raw = out.view(np.uint8)
    inside = np.cumsum(bits) - bits
    start = inside - inside[np.searchsorted(frame[at], np.arange(n_frames))][frame[at]]
    pos = 64 * word_at[frame[at]] + np.array([b for _, b in heads])[frame[at]] + start
    w, shift = pos >> 6, (pos & 63).astype(np.uint64)
    low = value.astype(np.uint64) << shift
    spill = np.where(shift > 0, value.astype(np.uint64) >> (np.uint64(63) - shift) >> np.uint64(1), np.uint64(0))
    cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    out[w[cut]] = np.add.reduceat(low, cut)
    out[w[cut] + 1] += np.add.reduceat(spill, cut)
    for k, (v, b) in enumerate(heads):
        a = 8 * int(word_at[k])
        head = np.frombuffer(v.to_bytes((b + 7) // 8, "little"), np.uint8)
        raw[a : a + len(head)] |= head
    return [raw[8 * a : 8 * a + (b + 7) // 8].tobytes() for a, b in zip(word_at.tolist(), need.tolist(), strict=True)]


def followed(head: tuple[int, int], *more: tuple[int, int]) -> tuple[int, int]:
    """(number, bits) of parts of a stream in order."""
    value, bits = head
    for v, n in more:
        value, bits = value | v << bits, bits + n
    return value, bits


def one_pixel(red: int, green: int, blue: int) -> tuple[int, int]:
    """(number, bits) of an image of one pixel within a transform."""
    return followed((0, 1), *((0b101 | c << 3, 11) for c in (green, red, blue, 255)), (0b0001, 4))


@lru_cache(maxsize=1)
def times_log(most: int) -> np.ndarray:
    """n log2 n of each n up to `most`."""
    n = np.arange(most + 1)
    return n * np.log2(np.maximum(n, 1))


def bits_of_literals(planes: np.ndarray, base: np.ndarray, n_frames: int) -> np.ndarray:
    """About how many bits the literals of each frame take, with the description of their codes. base: 256 times the frame of a pixel."""
    out = np.zeros(n_frames)
    for rows in ((1,), (0, 2, 3)):  # each code is described as often as it has channels
        counts = sum(np.bincount(base + planes[c], minlength=n_frames << 8) for c in rows).reshape(n_frames, 256)
        of = times_log(3 * ROWS * WIDTH)
        out += of[counts.sum(axis=1)] - of[counts].sum(axis=1) + 5 * len(rows) * np.count_nonzero(counts, axis=1)
    return out


def crossed(planes: np.ndarray, frame: np.ndarray, n_frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Channels less what green tells of red and blue, by least squares in each frame, and the multipliers."""
    red, green, blue = planes[:3].view(np.int8).astype(np.float64)
    n = np.bincount(frame, minlength=n_frames)
    mean = lambda x: np.bincount(frame, x, n_frames) / n
    middle = mean(green)
    spread = np.maximum(mean(green * green) - middle**2, 1e-9)
    by = np.stack([np.clip(np.rint(32 * (mean(green * c) - middle * mean(c)) / spread), -128, 127).astype(np.int16) for c in (red, blue)])
    out = planes.copy()
    for m, k in zip(by, (0, 2), strict=True):
        out[k] -= (m[frame] * planes[1].view(np.int8) >> 5).astype(np.uint8)
    return out, by.T & 255


def differences(rgba: np.ndarray, sizes: np.ndarray, frame: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Frames that a transform without a palette promises to shorten: which they are, their pixels, the numbers and widths of these, and
    the transform that promises most as it is written. Predictors are those that are undone by rows."""
    n, base, planes = len(sizes), frame << 8, np.ascontiguousarray(rgba.T)
    least, out, heads = bits_of_literals(planes, base, n), {}, {}

    def tried(changed: np.ndarray, bits: int, written) -> None:
        """One transform, and how it is written for a frame."""
        found = bits_of_literals(changed, base, n) + bits
        better = np.flatnonzero(found < least)
        least[better] = found[better]
        for k in better.tolist():
            out[k], heads[k] = changed[:, first[k] : first[k] + sizes[k]].T, written(k)

    first = np.cumsum(sizes) - sizes
    changed = planes.copy()
    changed[[0, 2]] -= planes[1]
    tried(changed, 3, lambda k: (0b101, 3))
    changed, by = crossed(planes, frame, n)
    tried(changed, 55, lambda k: followed((0b011, 3), (7, 3), one_pixel(0, int(by[k, 1]), int(by[k, 0]))))
    shifted = [np.concatenate([np.zeros((4, k), np.uint8), planes], axis=1)[:, : len(rgba)] for k in (1, WIDTH, WIDTH - 1, WIDTH + 1)]
    left, top, right, corner = shifted
    row, column = np.flatnonzero(place < WIDTH), np.flatnonzero((place % WIDTH == 0) & (place > 0))
    half = lambda a, b: (a & b) + ((a ^ b) >> 1)
    for mode in BY_ROWS:
        changed = planes - (half(corner, top) if mode == 8 else half(top, right) if mode == 9 else shifted[mode - 1])
        changed[:, row] = planes[:, row] - left[:, row]
        changed[:, column] = planes[:, column] - top[:, column]
        changed[:, first] = planes[:, first]
        changed[3, first] -= np.uint8(255)
        tried(changed, 55, lambda k, mode=mode: followed((0b001, 3), (7, 3), one_pixel(0, mode, 0)))
    which = np.array(sorted(out), np.int64)
    return which, np.concatenate([rgba[:0], *(out[k] for k in which)]), sizes[which], np.full(len(which), WIDTH), [heads[k] for k in which]


def palettes(rgba: np.ndarray, sizes: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The same for frames of at most 256 colours, each of them in two pixels or more in the mean, as a colour is dearer in a palette than
    as a pixel: pixels are places in a palette."""
    p = frame << 32 | rgba.view("<u4").ravel()
    every = np.sort(p)
    n = np.bincount(every[np.concatenate([[True], every[1:] != every[:-1]])] >> 32, minlength=len(sizes))
    which = np.flatnonzero((n <= 256) & (2 * n <= sizes))
    start = np.cumsum(sizes) - sizes
    steps, out, widths = [], [], []
    for k in which:
        colours, of = np.unique(p[start[k] : start[k] + sizes[k]], return_inverse=True)
        c = channels(colours)  # A, B, G, R, as the bytes of a pixel are read here
        steps.append(np.concatenate([c[:1], c[1:] - c[:-1] & 255])[:, (2, 3, 1, 0)])  # green, red, blue, alpha
        pack = 3 if n[k] <= 2 else 2 if n[k] <= 4 else 1 if n[k] <= 16 else 0
        green = (of.reshape(-1, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(axis=1)
        out.append(np.stack([0 * green, green, 0 * green, 0 * green], axis=-1).astype(np.uint8))
        widths.append(WIDTH >> pack)
    heads = []
    if steps:
        lengths = huffman_rows(np.array([np.bincount(c, minlength=256) for s in steps for c in s.T]))
        used = np.where(np.count_nonzero(lengths, axis=1)[:, None] > 1, lengths, 0)  # a single symbol takes no bits
        codes_ = canonical_rows(used)
        for k, s in enumerate(steps):
            described = [written_code(np.concatenate([x, np.zeros(LENGTHS, np.int64)]) if c == 0 else x) for c, x in enumerate(lengths[4 * k : 4 * k + 4])]
            literals = [(int(codes_[4 * k + c, x]), int(used[4 * k + c, x])) for pixel in s.tolist() for c, x in enumerate(pixel)]
            heads.append(followed((0b111, 3), (len(s) - 1, 8), (0, 1), *described, (0b0001, 4), *literals))
    return which, np.concatenate([rgba[:0], *out]), np.array([len(x) for x in out], np.int64), np.array(widths, np.int64), heads


def encode_frames(frames: list[bytes]) -> list[bytes]:
    """Lossless streams of frames, each of whole rows; all frames of the batch together. A frame is written with a transform if that makes
    it shorter: the one without a palette that promises most, or a palette."""
    sizes = np.array([len(f) // 4 for f in frames])
    rgba = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, 4)
    frame = np.repeat(np.arange(len(frames)), sizes)
    place = np.arange(len(rgba)) - (np.cumsum(sizes) - sizes)[frame]
    heads = [(0x2F | (WIDTH - 1) << 8 | (n // WIDTH - 1) << 22 | 1 << 36, 40) for n in sizes.tolist()]
    out = coded(rgba, sizes, np.full(len(sizes), WIDTH), heads)
    for which, pixels_, numbers, widths, written in (differences(rgba, sizes, frame, place), palettes(rgba, sizes, frame)):
        if len(which):
            made = coded(pixels_, numbers, widths, [followed(heads[k], w) for k, w in zip(which, written, strict=True)])
            for k, stream in zip(which, made, strict=True):
                out[k] = min(out[k], stream, key=len)
    return out


def padded(data: bytes) -> bytes:
    """`data` and spaces up to a positive multiple of ROW_BYTES."""
    return data + b" " * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Files of padded payloads."""
    step = ROWS * ROW_BYTES
    cut = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    made = iter(encode_frames([f for c in cut for f in c])) if cut else iter(())
    return [container([(WIDTH, len(f) // ROW_BYTES, next(made)) for f in c]) for c in cut]


def decode_payloads(files: list[bytes]) -> list[bytes]:
    return [b"".join(s for _, _, s in frames) for frames in decode_files(files)]


# ---------------------------------------------------------------- Spark


def _parts(values: pa.Array) -> Iterator[list[bytes]]:
    """Values as bytes (null: empty), in lists of about BATCH_BYTES."""
    part, size = [], 0
    for v in values:
        v = v.as_py() or b""
        part.append(v.encode() if isinstance(v, str) else v)
        size += len(part[-1]) + ROW_BYTES
        if size >= BATCH_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about BATCH_BYTES of text, as decoding in step takes as long for few streams as for many."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _added(df: DataFrame, source: str, name: str, make) -> DataFrame:
    df = common.giving_way(df, [name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(name, pa.array([x for part in _parts(b.column(source)) for x in make(part)], pa.binary()))

    return df.transform(common.in_arrow, run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def encoded(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the WebP file of each text's padded bytes."""
    return _added(df, text, media, lambda part: encode_payloads([padded(x) for x in part]))


def decoded(df: DataFrame, media: str = "media", samples_: str = "samples") -> DataFrame:
    """Adds the RGBA samples of all frames of each file; null or empty files give none."""

    def make(part: list[bytes]) -> list[bytes]:
        got = iter(decode_payloads([f for f in part if f]))
        return [next(got) if f else b"" for f in part]

    return _added(df, media, samples_, make)


def feature(payload: bytes) -> str:
    """Mean sample, entropy in bits and number of distinct samples of a pixel array, and the mean of each quarter."""
    a = np.frombuffer(payload, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    some = share[share > 0]
    quarters = [f"{q.mean():.2f}" for q in np.array_split(a, 4)]
    return f"mean={a.mean():.4f};entropy={-(some * np.log2(some)).sum():.4f};distinct={len(some)};quarters={','.join(quarters)}"


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, "text"):
            ids, k = b.column("doc_id"), 0
            for part in _parts(b.column("text")):
                files = encode_payloads([padded(x) for x in part])
                back = decode_payloads(files)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[k : k + len(part)], pa.array([len(x) for x in part], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()), pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array([feature(x) for x in back]),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )
                k += len(part)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.documents(spark, sf_dir).select("doc_id", "text").transform(common.in_arrow, run, schema)
