import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.splitting import pieces, split_oversized


def whole(text, parts, overlap):
    return text[: parts[0][1]] + "".join(text[a + overlap : b] for a, b in parts[1:])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\ńé", max_size=400), st.integers(11, 60))
def test_round_trip_and_limit(text, limit):
    overlap = limit // 3
    p = pieces(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in p) or text == ""
    assert whole(text, p, overlap) == text
    assert (len(p) == 1) == (len(text) <= limit)


def test_cut_falls_between_topics():
    a = "Cells divide in the cold medium. " * 12
    b = "Taxes rose in every northern county. " * 12
    (x, cut), _ = pieces(a + b, 700, 50)[:2]
    assert x == 0 and cut == len(a)


def test_without_boundaries():
    assert pieces("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    with pytest.raises(ValueError):
        pieces("x" * 25, 10, 5)


def test_frame(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta.", "gamma", "delta\n"]) for _ in range(20000))
    rows = [(1, long, 5), (1, long, 5), (2, "short", 6), (3, None, 7), (4, "", 8), (5, "é" * 3001, 9)]
    df = spark.createDataFrame(rows, "id long, body string, piece int")
    got = split_oversized(df, "body", 1500, 200).collect()
    assert {r.id for r in got} == {1, 5}
    one = sorted((r.piece, r.begin, r.end, r.piece_text) for r in got if r.id == 1)
    assert len(one) == 2 * len(set(one)) and all(len(x[3]) <= 1500 and long[x[1] : x[2]] == x[3] for x in one)
    assert split_oversized(df.limit(0), "body").count() == 0


def test_boundary_in_the_first_half_comes_before_a_hard_cut():
    assert pieces("One two. " + "x" * 30, 30, 2)[0] == (0, 9)
    assert pieces("one two " + "x" * 30, 30, 2)[0] == (0, 8)
