"""Every code point, random sequences of marks, and whole tables against the tokenizers library."""

import hashlib

import numpy as np
import pytest

from voxelframe.llm import bpe
from voxelframe.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, n_tokens long, ids string, at long"


@pytest.fixture(scope="module")
def both():
    return tokenizers.Tokenizer.from_file(tokenizer_path()), bpe.Bpe(tokenizer_path())


def test_every_code_point(both):
    t, b = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(points), 256):
        text = " ".join(f"x{c}x 5{c}5 !{c}!" for c in map(chr, points[at : at + 256]))
        if t.encode(text, add_special_tokens=False).ids != b.encode(text):
            wrong += [hex(c) for c in points[at : at + 256] if t.encode(f"x{chr(c)}x 5{chr(c)}5 !{chr(c)}!", add_special_tokens=False).ids != b.encode(f"x{chr(c)}x 5{chr(c)}5 !{chr(c)}!")]
    assert not wrong


def test_sequences_of_marks_compose_alike(both):
    import unicodedata

    t, b = both
    rng = np.random.default_rng(3)
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c)) or chr(c) in "ͅ\U00011930\U00011935"]
    bases = [chr(c) for c in (*range(0x41, 0x5B), 0xE9, 0x1100, 0x1161, 0x11A8, 0x1F71, 0x915, 0x93C, 0x11935, 0xAC00, 0x3A3, 0x130)]
    for _ in range(3000):
        text = "".join(str(rng.choice(bases)) + "".join(rng.choice(marks, rng.integers(0, 5))) for _ in range(4))
        assert t.encode(text, add_special_tokens=False).ids == b.encode(text), ascii(text)


def test_tables(spark, both):
    t, b = both
    assert bpe.encode(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
    long = "Lorem ipsum, 12 dolor's " * 20_000 + "x" * 100_000
    rows = [(1, None, 5, "i", 0), (1, "", 5, "i", 0), (2, long, 5, "i", 0), (3, "a\x1cb c퟿", 5, "i", 0), (3, "a\x1cb c퟿", 5, "i", 0), (None, "x", 5, "i", 0)]
    got = sorted(map(tuple, bpe.encode(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_fragments_never_cut_a_token(both):
    _, b = both
    for token in list(b.vocab)[::7]:
        assert len(b.fragments(b._pieces(token))) == 1
