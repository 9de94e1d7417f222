import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from helpers import frame, prose, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from triplespan.llm import bpe


@pytest.fixture(scope="module")
def known():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    found = bpe.PerfectHash(keys)
    assert [found.slot(k) for k in keys] == list(range(3000)) and found.slot(b"other") == -1
    assert bpe.PerfectHash([]).slot(b"a") == -1 and bpe.PerfectHash([b"x"]).slot(b"x") == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab' \n1é日_!", max_size=80))
def test_any_text(known, text):
    got = bpe.codec().encode(text)
    assert got == known.encode_ordinary(text) and bpe.codec().decode(got) == text.encode()


def test_long_pieces(known):
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>", "日" * 900):
        assert bpe.codec().encode(text) == known.encode_ordinary(text)


def test_table(spark, known):
    rows = bpe.digests(frame(spark)).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in frame(spark).collect()), key=str)
    assert len(rows) == len(want)
    by_id = {(r["doc_id"], r["ids_sha256"]): r for r in rows}
    for i, t in want:
        ids = known.encode_ordinary(t or "")
        r = by_id[i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_columns(spark):
    df = bpe.decode(bpe.encode(texts(spark, "a b", None, "")))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in df.collect()} == {0: b"a b", 1: b"", 2: b""}
    assert bpe.encode(frame(spark, [])).count() == 0
    assert bpe.encode(df).columns == [*(c for c in df.columns if c != "token_ids"), "token_ids"]  # an output replaces a column of its name
    assert bpe.encoded_with_digest(texts(spark, prose(1, 9))).first()["n_tokens"] > 9
