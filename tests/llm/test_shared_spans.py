import random

import numpy as np
import pytest

from tesserae.llm.shared_spans import factors, parse, shared_spans


def brute(rows, length):
    seen = {}
    for i, o, t in rows:
        if i is not None and o is not None and t:
            for p in range(len(t) - length + 1):
                seen.setdefault(t[p : p + length], set()).add(o)
    out = {}
    for i, o, t in rows:
        if i is not None and o is not None and t:
            cover = set()
            for p in range(len(t) - length + 1):
                if len(seen[t[p : p + length]]) > 1:
                    cover |= set(range(p, p + length))
            spans = []
            for c in sorted(cover):
                if spans and spans[-1][1] == c:
                    spans[-1][1] = c + 1
                else:
                    spans.append([c, c + 1])
            # windows that touch are one span as well
            if spans:
                out[i] = [tuple(s) for s in spans]
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(6)]
    rows = []
    for i in range(60):
        b = rng.choice(base)
        a = rng.randrange(len(b))
        rows.append((i, rng.randrange(8), text(rng.randint(0, 20)) + b[a : a + rng.choice([30, 39, 40, 41, 90])] + text(rng.randint(0, 20))))
    rows += [(100, 1, base[0]), (101, 1, base[0]), (102, 2, base[0]), (103, 3, "a" * 100), (104, 3, "a" * 100), (105, 4, "a" * 45), (106, None, base[0]), (107, 5, None), (108, 5, ""), (109, 6, "ab" * 80), (110, 7, "xab" + "ab" * 30)]
    return rows


@pytest.mark.parametrize("crowd", [4096, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "chunk_id long, paper_id long, text string, spans string, id int")
    got = {r.id: [(s.begin, s.end) for s in r.spans] for r in shared_spans(df, "chunk_id", "paper_id", "text", length=40, k=12, crowd=crowd).collect()}
    assert got == brute(rows, 40)


def test_phrases_beside_a_crowd_stay_together(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(60)
    rows = [(i, i, text(30) + shared + text(30)) for i in range(40)]
    for p in range(60):
        span = text(60)
        rows += [(1000 + 2 * p + i, 2 * p + i, text(20) + span + text(20)) for i in (0, 1)]
    rng.shuffle(rows)
    # several tasks, as with large tables
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "a long, b long, t string")
        got = {r.id for r in factors(df, "a", "b", "t", length=40, k=12, crowd=20).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {r[0] for r in rows}


def test_share_and_empty(spark):
    rows = [(1, 1, "x" * 10 + "abcdefghij" * 2), (2, 2, "abcdefghij" * 2)]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    got = {r.id: (r.shared_chars, r.share) for r in shared_spans(df, "a", "b", "t", length=20, k=8).collect()}
    assert got == {1: (20, 0.666667), 2: (20, 1.0)}
    assert shared_spans(df.limit(0), "a", "b", "t").count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_parse_is_greedy_and_longest(seed):
    rows = [r for r in corpus(seed) if r[1] is not None and r[2]]
    texts, owner, n = [r[2] for r in rows], np.array([r[1] for r in rows]), 30

    def longest(i, p):
        best = 0
        for j, t in enumerate(texts):
            if owner[j] != owner[i]:
                m = n - 1
                while p + m < len(texts[i]) and texts[i][p : p + m + 1] in t:
                    m += 1
                best = max(best, m if m >= n and texts[i][p : p + m] in t else 0)
        return best

    got = {}
    for i, b, m, j, c in zip(*parse(texts, owner, n), strict=True):
        assert owner[i] != owner[j] and texts[i][b : b + m] == texts[j][c : c + m]
        got.setdefault(int(i), []).append((int(b), int(m)))
    for i in range(0, len(texts), 5):
        want, p = [], 0
        while p <= len(texts[i]) - n:
            m = longest(i, p)
            if m:
                want.append((p, m))
            p = p + m - n + 1 if m else p + 1
        assert got.get(i, []) == want, i


def test_factors_have_sources(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "i long, o long, t string")
    text, own = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    got = factors(df, "i", "o", "t", length=40, k=12).collect()
    assert got and all(text[r.id][r.begin : r.end] == text[r.source][r.source_begin : r.source_begin + r.end - r.begin] and own[r.id] != own[r.source] and r.end - r.begin >= 40 for r in got)


def test_crowd_of_copies(spark):
    """Copies under one owner and under many, beside texts that share a part with them."""
    a, b, c = ("".join(random.Random(x).choice("abcdefgh ") for _ in range(120)) for x in "xyz")
    rows = [(i, 1, a) for i in range(300)] + [(1000 + i, i % 7, b) for i in range(300)] + [(2000 + i, 5, c) for i in range(50)]
    rows += [(3000, 1, "zz" + a[10:70]), (3001, 2, a[50:110] + "qq"), (3002, 9, b[:45] + "--"), (3003, 5, c[:60]), (3004, 6, c[20:80]), (3004, 6, c[20:80])]
    df = spark.createDataFrame(rows, "i long, o long, t string")
    for crowd in (4096, 2):
        got = {r.id: [(s.begin, s.end) for s in r.spans] for r in shared_spans(df, "i", "o", "t", length=40, k=12, crowd=crowd).collect()}
        assert got == brute(rows, 40)
    text, own = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    for r in factors(df, "i", "o", "t", length=40, k=12).collect():
        assert own[r.id] != own[r.source] and text[r.id][r.begin : r.end] == text[r.source][r.source_begin : r.source_begin + r.end - r.begin]
