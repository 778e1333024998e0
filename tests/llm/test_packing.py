import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.packing import fill_containers, fill_report, pack


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=80))
def test_no_overlap_and_few_containers(sizes):
    box, start = pack(np.asarray(sizes, np.int64), 30)
    per = {}
    for b, s, n in zip(box.tolist(), start.tolist(), sizes, strict=True):
        per.setdefault(b, []).append((s, n))
    for x in per.values():
        at = 0
        for s, n in sorted(x):
            assert s == at
            at += n
        assert at <= 30
    if sizes:
        # never two containers that could be one, so fewer than twice the least number
        fill = sorted(sum(n for _, n in x) for x in per.values())
        assert len(fill) < 2 or fill[0] + fill[1] > 30 or sum(n == 0 for n in sizes) == len(sizes)


def test_large_pairs():
    box, _ = pack(np.asarray([60, 50, 40, 35, 41, 10], np.int64), 100)
    assert len(set(box.tolist())) == 3 and box[0] == box[2] and box[1] == box[4]


def test_frame(spark):
    rows = [(1, 250), (2, 0), (3, None), (4, 100), (5, 30), (5, 30), (6, 70), (7, -4), (None, 5)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, n int, start string")
    got = fill_containers(df, "n", 100, 4).collect()
    # the same rows, split otherwise, give the same containers
    again = fill_containers(df.orderBy("n").repartition(5), "n", 100, 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len({r.container >> 32 for r in got}) == 3
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.length))
    assert sorted(by[1]) == [(0, 100), (1, 100), (2, 50)] and by[4] == [(0, 100)] and by[2] == [(0, 0)] == by[3] == by[7] and len(by[5]) == 2
    load = {}
    for r in got:
        load.setdefault(r.container, []).append((r.start, r.length))
    for x in load.values():
        at = 0
        for s, n in sorted(x):
            assert s == at
            at += n
        assert at <= 100
    rep = fill_report(fill_containers(df, "n", 100), 100).first()
    assert rep.tokens == 485 and rep.containers >= rep.least == 5
    assert fill_containers(df.limit(0), "n", 100).count() == 0
    assert fill_report(fill_containers(df.limit(0), "n", 100), 100).first().filled is None
