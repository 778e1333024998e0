import random
import re

import numpy as np
import pytest

from tesserae.llm.near_duplicates import Join, NearDuplicates, join_nodes, near_duplicates, shingles


def brute(rows, j):
    sets = {}
    for tbl, i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= max(j.words, j.least_words):
            sets[tbl, i] = {tuple(w[k : k + j.words]) for k in range(len(w) - j.words + 1)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for k, a in enumerate(keys) for b in keys[k + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= j.threshold}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "naïve", "x_y", "10⁶"]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 20])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((rng.choice(["c", "p"]), i, " ".join(w)))
    rows += [("c", 1000, "few words only"), ("c", 1001, None), ("c", 1002, ""), ("c", 1003, rows[0][2].upper() + "!"), ("p", 1004, rows[0][2])]
    return rows


@pytest.mark.parametrize("j", [Join(3, 0.6), Join(5, 0.8), Join(3, 0.6, leaf=2, crowd=6)])
def test_equals_brute_force(spark, j):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "tbl string, id long, text string, rep string")
    got = near_duplicates(df, j)
    found = {(r.tbl, r.id_a, r.id_b) for r in got.expanded().collect()}
    assert found == brute(rows, j)
    if j == Join(5, 0.8):
        groups = {(r.tbl, r.id): r.group_id for r in got.groups().collect()}
        assert set(groups) == {(t, x) for t, a, b in found for x in (a, b)}
        assert all(groups[t, a] == groups[t, b] for t, a, b in found)


def test_words_equal_a_regular_expression():
    texts = ["Été d'hiver x_y 10⁶ IFN-γ", "", "one", "a b c d e", "\U00010400x y z"]
    bounds, run, key = shingles(texts, 1, 0)
    assert np.diff(bounds).tolist() == [len(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    assert shingles(["A b"], 1, 0)[1].tolist() == shingles(["--a  B"], 1, 0)[1].tolist() and shingles(["a b"], 1, 0)[2] == shingles(["A,b"], 1, 0)[2] != shingles(["b a"], 1, 0)[2]


def test_alike_throughout():
    sk = np.zeros((200, 32), np.uint8)
    a, b = join_nodes(np.zeros(200, np.uint64), sk, 20, leaf=10, depth=2)
    assert len({(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}) == 200 * 199 // 2


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    j = Join(3, 0.6)
    met = 0
    n = 400
    for _ in range(n):
        same = rng.random(SKETCH := 32) < 0.62
        met += same.sum() >= j.agree
    assert j.trees >= 9 and met >= n - 2
    assert SKETCH == 32


def test_empty(spark):
    got = near_duplicates(spark.createDataFrame([], "tbl string, id long, text string"))
    assert got.expanded().count() == 0 and got.groups().count() == 0


def test_groups_of_more_tables_than_a_thousand(spark):
    n = 1100
    members = spark.range(n).selectExpr("concat('t', lpad(id, 4, '0')) AS tbl", "explode(array(1L, 2L, 3L)) AS id").selectExpr("tbl", "id", "id AS rep")
    pairs = spark.range(n).selectExpr("concat('t', lpad(id, 4, '0')) AS tbl", "explode(array(1L, 2L)) AS a").selectExpr("tbl", "a", "a + 1 AS b", "1.0D AS similarity")
    got = NearDuplicates(members, pairs).groups().where("id = 3 AND group_id = 1 AND tbl >= 't1050'").count()
    assert got == 50
