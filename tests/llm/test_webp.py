import base64
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from triplespan.llm import webp


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=9000) | st.text(max_size=50).map(str.encode), max_size=5))
def test_round_trip(payloads):
    padded = [webp.padded(p) for p in payloads]
    assert webp.decode_payloads(webp.encode_payloads(padded)) == padded


def test_long_payloads():
    padded = [webp.padded(x) for x in (b"", b"a" * 192, b"ab" * 90_000, prose(1, 20_000).encode(), bytes(range(256)) * 300)]
    files = webp.encode_payloads(padded)
    assert webp.decode_payloads(files) == padded and files == webp.encode_payloads(padded)
    assert all(f[:4] == b"RIFF" and f[8:12] == b"WEBP" and len(f) == 8 + int.from_bytes(f[4:8], "little") for f in files)
    with pytest.raises(ValueError):
        webp.decode_payloads([files[3][: len(files[3]) // 2]])


def test_known_file():
    """A public one-pixel file that another program wrote."""
    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    ((width, height, samples),) = webp.decode_files([file])[0]
    assert (width, height, len(samples)) == (1, 1, 4)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        self.value |= int(value) << self.n
        self.n += n

    def image(self, pixels, top, cache=False):
        """An image of literals, each channel with a code of its own."""
        self.put(0, 1)
        if top:
            self.put(0, 1)
        channels = [(pixels >> s & 255) for s in (8, 16, 0, 24)]
        codes = []
        for k, c in enumerate(channels):
            counts = np.bincount(c, minlength=256 + 24 if k == 0 else 256)
            lengths = webp.huffman(counts.tolist())
            value, n = webp.written_code(lengths)
            self.put(value, n)
            codes.append((webp.canonical(lengths), [x if sum(map(bool, lengths)) > 1 else 0 for x in lengths]))
        self.put(0b1_0011 & 0b11111, 4) if False else self.put(0b0001, 4)  # a simple code of one symbol, 0, for distances
        for i in range(len(pixels)):
            for c, (code, lengths) in zip(channels, codes, strict=True):
                self.put(code[c[i]] if lengths[c[i]] else 0, lengths[c[i]])

    def stream(self):
        return self.value.to_bytes((self.n + 7) // 8 + 1, "little")


def head(width, height):
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def decoded(w, width, height):
    (_, _, samples), = webp.decode_files([webp.container([(width, height, w.stream())])])[0]
    return np.frombuffer(samples, np.uint8).reshape(-1, 4)


def argb(rgba):
    r, g, b, a = rgba.T.astype(np.int64)
    return a << 24 | r << 16 | g << 8 | b


@pytest.fixture
def image():
    return np.random.default_rng(5).integers(0, 256, (9 * 7, 4), dtype=np.uint8)


def test_subtract_green(image):
    w = head(9, 7)
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    c = image.astype(np.int64)
    changed = np.stack([c[:, 0] - c[:, 1] & 255, c[:, 1], c[:, 2] - c[:, 1] & 255, c[:, 3]], 1)
    w.image(argb(changed), True)
    assert (decoded(w, 9, 7) == image).all()


def test_cross_colour(image):
    r2b, g2b, g2r = 200, 35, 130
    signed = lambda x: (x & 255 ^ 128) - 128
    c = image.astype(np.int64)
    red = c[:, 0] - (signed(g2r) * signed(c[:, 1]) >> 5) & 255
    blue = c[:, 2] - (signed(g2b) * signed(c[:, 1]) >> 5) - (signed(r2b) * signed(c[:, 0]) >> 5) & 255
    w = head(9, 7)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.image(np.full(6, 255 << 24 | r2b << 16 | g2b << 8 | g2r), False)
    w.put(0, 1)
    w.image(argb(np.stack([red, c[:, 1], blue, c[:, 3]], 1)), True)
    assert (decoded(w, 9, 7) == image).all()


def predict(mode, left, top, right, corner):
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if abs(p - left).sum() < abs(p - top).sum() else top
    clamp = lambda x: np.minimum(255, np.maximum(0, x))
    return {
        0: np.array([0, 0, 0, 255]), 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top),
        9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)), 12: clamp(left + top - corner), 13: clamp(avg(left, top) + np.trunc((avg(left, top) - corner) / 2).astype(int)),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(image, mode):
    width, c = 9, image.astype(np.int64)
    rest = c.copy()
    for i in range(len(c)):
        y, x = divmod(i, width)
        if i == 0:
            p = np.array([0, 0, 0, 255])
        elif y == 0:
            p = c[i - 1]
        elif x == 0:
            p = c[i - width]
        else:
            p = predict(mode, c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        rest[i] = c[i] - p & 255
    w = head(9, 7)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    w.image(np.full(6, mode << 8), False)
    w.put(0, 1)
    w.image(argb(rest), True)
    assert (decoded(w, 9, 7) == image).all()


@pytest.mark.parametrize("colours", [2, 4, 11, 40])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    palette, at = rng.integers(0, 256, (colours, 4), dtype=np.uint8), rng.integers(0, colours, 9 * 7)
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    w = head(9, 7)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    c = palette.astype(np.int64)
    w.image(argb(np.concatenate([c[:1], c[1:] - c[:-1] & 255])), False)
    w.put(0, 1)
    packed = -(-9 >> pack)
    green = np.zeros(7 * packed, np.int64)
    for i, v in enumerate(at):
        y, x = divmod(i, 9)
        green[y * packed + (x >> pack)] |= v << ((x & (1 << pack) - 1) * (8 >> pack))
    w.image(255 << 24 | green << 8, True)
    assert (decoded(w, 9, 7) == palette[at]).all()


def test_table(spark, monkeypatch):
    monkeypatch.setattr(webp.common, "documents", lambda spark, _: frame(spark))
    rows = webp.op1_webp_media(spark, "").collect()
    texts = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in frame(spark).collect()), key=str)
    assert len(rows) == len(texts)
    of = {(r["doc_id"], r["payload_sha256"]): r for r in rows}
    for i, t in texts:
        p = t + b" " * (max(192, -(-len(t) // 192) * 192) - len(t))
        r = of[i, hashlib.sha256(p).hexdigest()]
        file = webp.encode_payloads([p])[0]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(file), hashlib.sha256(file).hexdigest(), described(p))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(t), len(p), zlib.crc32(p[-16:])) and len(p) % 192 == 0 < len(p)
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (1, 2)}) == 1


def described(p):
    """The feature string by plain counting."""
    share = [p.count(bytes([v])) / len(p) for v in range(256) if p.count(bytes([v]))]
    k, more = divmod(len(p), 4)
    quarters = [p[i * k + min(i, more) : (i + 1) * k + min(i + 1, more)] for i in range(4)]
    return f"mean={sum(p) / len(p):.4f};entropy={-sum(s * math.log2(s) for s in share):.4f};distinct={len(share)};quarters={','.join(f'{sum(q) / len(q):.2f}' for q in quarters)}"


def test_columns(spark):
    df = webp.decoded(webp.encoded(frame(spark)))
    assert all(bytes(r["samples"]) == webp.padded((r["text"] or "").encode()) for r in df.collect())
    assert webp.encoded(df).columns == [*(c for c in df.columns if c != "media"), "media"]  # an output replaces a column of its name
    assert webp.encoded(frame(spark, [])).count() == 0


def test_codes_of_all_frames_together_are_those_of_one_heap_each():
    import heapq

    def plain(counts):
        weights = {i: c for i, c in enumerate(counts) if c}
        while True:
            heap, depth = [(w, i, [i]) for i, w in weights.items()], dict.fromkeys(weights, 0)
            heapq.heapify(heap)
            for node in range(len(counts), len(counts) + len(heap) - 1):
                (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
                depth |= {i: depth[i] + 1 for i in x + y}
                heapq.heappush(heap, (a + b, node, x + y))
            if max(depth.values()) <= webp.LONGEST:
                return [depth.get(i, 0) for i in range(len(counts))]
            weights = {i: (w + 1) >> 1 for i, w in weights.items()}

    rng = np.random.default_rng(5)
    rows = [[1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, *[0] * 44], [7, 7, *[0] * 58], [1] * 60]
    rows += [(rng.integers(0, 9, 60) ** int(rng.integers(1, 5))).tolist() for _ in range(40)]
    assert webp.huffman_rows(np.array(rows)).tolist() == [plain(r) for r in rows]
    assert webp.huffman_rows(np.array([[0, 0, 4], [0, 0, 0]])).tolist() == [[0, 0, 1], [0, 0, 0]]


def test_small_batches_are_decoded_together():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array(["a" * 1000 if i % 3 else None], pa.string())}) for i in range(50)]
    (got,) = webp._gathered(iter(batches), "text")
    assert got.column("doc_id").to_pylist() == list(range(50)) and got.column("text").null_count == 17
    assert len(list(webp._gathered(iter(batches * 200), "text"))) > 1 and not list(webp._gathered(iter([]), "text"))


def kinds_of(file):
    return [[(kind, int(data[0]) >> 8 & 15 if kind == 0 else None if data is None else len(data)) for kind, _, _, data in webp.Header(webp.Bits(s)).transforms] for s in webp.streams(file)]


def plain_size(payload):
    rgba = np.frombuffer(payload, np.uint8).reshape(-1, 4)
    rows = len(rgba) // webp.WIDTH
    (stream,) = webp.coded(rgba, np.array([len(rgba)]), np.array([webp.WIDTH]), [(0x2F | (webp.WIDTH - 1) << 8 | (rows - 1) << 22 | 1 << 36, 40)])
    return len(webp.container([(webp.WIDTH, rows, stream)]))


def of_kind(kind):
    """A payload that one transform shortens."""
    rng, n = np.random.default_rng(3), webp.ROWS * webp.WIDTH
    c = rng.integers(0, 256, (n, 4), dtype=np.uint8)
    c[:, 1] >>= 1
    if kind == "green":
        c[:, 0] = c[:, 2] = c[:, 1] + 7
    elif kind == "cross":
        c[:, 0], c[:, 2] = c[:, 1] >> 1, c[:, 1] >> 2
    elif isinstance(kind, int):
        c = rng.integers(0, 256, (webp.ROWS, webp.WIDTH, 4), dtype=np.uint8)
        noise = rng.integers(0, 3, c.shape, dtype=np.uint8)
        for y in range(webp.ROWS):
            for x in range(webp.WIDTH):
                if x if kind == 1 else y:
                    over = c[y - 1] if y and kind != 1 else None
                    by = [None, c[y, x - 1], *((over[x], over[x + 1] if x + 1 < webp.WIDTH else c[y, 0], over[x - 1]) if over is not None else (None,) * 3)]
                    mean = lambda a, b: ((a.astype(int) + b) // 2).astype(np.uint8)
                    at = by[2] if not x and kind != 1 else by[kind] if kind < 5 else mean(by[4], by[2]) if kind == 8 else mean(by[2], by[3])
                    c[y, x] = at + noise[y, x]
    else:  # the colours in a few patterns of eight pixels
        patterns = np.arange(max(3, kind[1] // 8) * 8).reshape(-1, 8) % kind[1]
        c = rng.integers(0, 256, (kind[1], 4), dtype=np.uint8)[patterns[rng.integers(0, len(patterns), n // 8)].ravel()]
    return c.tobytes()


@pytest.mark.parametrize(("kind", "want"), [("green", (2, None)), ("cross", (1, 1)), *((m, (0, m)) for m in webp.BY_ROWS), *((("palette", k), (3, k)) for k in (2, 4, 16, 200))])
def test_written_transforms(kind, want):
    """The writer's own files hold a transform where it shortens them, and pass through its inverse."""
    payload = of_kind(kind)
    (file,) = webp.encode_payloads([payload])
    assert webp.decode_payloads([file]) == [payload] and kinds_of(file) == [[want]] and len(file) < plain_size(payload)
    batch = [b"a" * 192, payload, bytes(range(192)), payload[:192]]
    assert webp.encode_payloads(batch)[1] == file and webp.decode_payloads(webp.encode_payloads(batch)) == batch


def test_transforms_in_files_of_documents():
    """Files of sf0.01 are never longer than without transforms, and some hold predictors and palettes."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    payloads = [webp.padded((x or "").encode()) for x in texts]
    files = webp.encode_payloads(payloads)
    assert webp.decode_payloads(files) == payloads
    found = [kinds_of(f) for f in files]
    assert {k for f in found for s in f for k, _ in s} >= {0, 3}
    for file, kinds, payload in zip(files, found, payloads, strict=True):
        if len(kinds) == 1 and kinds[0]:
            assert len(file) < plain_size(payload)


@pytest.mark.parametrize("mode", webp.BY_ROWS)
@pytest.mark.parametrize("width", [1, 2, 9])
def test_rows_are_undone_as_pixels_are(monkeypatch, mode, width):
    rest, modes = np.random.default_rng(mode).integers(0, 1 << 32, 5 * width), np.full(1, mode << 8)
    found = webp.unpredicted(rest, width, 9, modes)
    monkeypatch.setattr(webp, "BY_ROWS", ())
    assert (found == webp.unpredicted(rest, width, 9, modes)).all()
