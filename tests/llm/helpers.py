"""Documents that show the hard cases, for all corpus operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    """n words, the same for the same seed."""
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def cases():
    """Nulls in any column, empty, blank and very long texts, repeated rows, copies, near copies and other scripts."""
    base = prose(1, 200)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "two words"), (8, "Two WORDS"), (9, prose(2, 20_000)), (9, prose(2, 20_000)),
        (10, "naïve 日本語 тест 😀 " * 30), (11, base + " " + prose(3, 150)), (12, "a b c d e"), (13, "a b c d e f"), (14, "x\x00y\x85z\xa0w " * 9), (15, "line\nline\n\nline\n" * 8), (None, prose(4, 40)),
    ]
    return [(i, t, None if i == 7 else "xx", None if i == 5 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(cases() if rows is None else rows, SCHEMA)


def texts(spark, *values):
    return frame(spark, [(i, t, "xx", "s", len(t) if t is not None else None) for i, t in enumerate(values)])
