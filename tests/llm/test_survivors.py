from datetime import datetime as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

import numpy as np
import pytest

from tesserae.llm.survivors import best_papers, best_sources, components, group_order, identifier, learn_transitions, with_currency, written

SCHEMA = "paper_id long, doc_id string, pmid string, pmcid string, title string, abstract string, in_index boolean, loaded_at timestamp, extra string, trust int"
TARS = [("good.tar", 1, 5), ("poor.tar", 1, 9)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA), spark.createDataFrame(TARS, "tar string, bytes long, trust int")


def test_identifier(spark):
    vals = ["PMC41000198.1", " 71000171.0", "PMID: 071", "0", "-", "NA", "", None, "pmcid:5.v2"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(identifier(F.col("v"))).collect()] == ["41000198", "71000171", "71", None, None, None, None, None, "5"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 14), st.integers(0, 12)), max_size=25))
def test_components_equal_union_find(spark, pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, k in pairs:
        a, b = find(("i", i)), find(("k", k))
        root[a] = b
    comp = {}
    for i, _ in pairs:
        comp.setdefault(find(("i", i)), set()).add(i)
    want = {(i, min(c)) for c in comp.values() if len(c) > 1 for i in c}
    got = {(r.id, r.group_id) for r in components(spark.createDataFrame([(i, f"k{k}") for i, k in pairs], "id long, key string")).collect()}
    assert got == want


def test_chain(spark):
    pairs = [(i, f"e{j}") for i in range(1, 41) for j in (i, i + 1)]
    got = components(spark.createDataFrame(pairs, "id long, key string")).collect()
    assert len(got) == 40 and {r.group_id for r in got} == {1}


def test_fields(spark):
    rows = [
        (10, "tar://poor.tar!/a.xml", "PMID:7", "", "T", "longer abstract", True, D(2024, 5, 1)),
        (4, "tar://good.tar!/a.xml", "7.0", "PMC5", "", "short", False, D(2024, 1, 1)),
        (6, "tar://good.tar!/b.xml", "0", "5", "U", "same length abc", None, D(2024, 2, 1)),
        (8, None, "-", "PMC5.2", " ", None, True, None),
        (20, "tar://none.tar!/z", "99", "n/a", "alone", "x", True, D(2024, 1, 1)),
        (30, "", None, None, None, None, None, None),
        (31, "", None, None, None, None, None, None),
        (40, "same", None, None, None, "", None, None),
        (41, "same", "-", None, None, "", None, None),
        (41, "same", "-", None, None, "", None, None),
    ]
    got = {r.group_id: r for r in best_papers(*frame(spark, rows)).collect()}
    assert set(got) == {4, 40}
    r = got[4]
    assert (r.pmid_from, r.pmcid_from, r.abstract_from, r.title_from, r.doc_id_from, r.in_index_from, r.n_rows) == (4, 6, 6, 6, 6, 10, 4)
    assert (r.pmid, r.pmcid) == ("7", "5")
    assert (got[40].pmid_from, got[40].pmcid_from, got[40].abstract_from) == (0, 0, 0)
    assert best_papers(*frame(spark, [])).count() == 0


def test_written(spark):
    vals = ["71000171", "71000171.0", "PMID: 071", "0", "-", "", None, "PMC5.v2"]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(written(F.col("v"))).collect()] == ["bare", "decimal", "dressed", "word", "word", "none", "none", "dressed"]


KINDS = "group_id long, kinds array<string>, t timestamp, n int"


def test_transitions_are_learned(spark):
    rows = [(g, [k, "x"], D(2024, 1, d), 0) for g in range(5) for d, k in enumerate(("draft", "final", "fixed"), 1)] + [(9, ["final", "x"], D(2024, 1, 1), 0), (9, ["draft", "x"], D(2024, 2, 1), 0)]
    w = learn_transitions(spark.createDataFrame(rows, KINDS), "group_id", "kinds", "t")
    assert w == {(0, "draft", "final"): pytest.approx(4 / 6), (0, "draft", "fixed"): 1.0, (0, "final", "fixed"): 1.0}


def test_order_of_a_group():
    w = {(0, "a", "b"): 1.0, (0, "b", "c"): 0.5, (0, "a", "c"): 0.5}
    nan = np.nan
    # a (time 5), b, c untimed: c comes after b and b after a
    level, after = group_order([("a",), ("b",), ("c",)], np.array([5, nan, nan]), w)
    assert level.tolist() == [0, 1, 2] and after.tolist() == [-np.inf, 5, 5]
    # kinds that were never seen are not ordered
    assert group_order([("a",), ("z",)], np.array([5, nan]), w)[1].tolist() == [-np.inf, -np.inf]
    # times overrule what was learned, and circles end
    level, after = group_order([("c",), ("a",), ("b",)], np.array([1, 7, nan]), w | {(0, "c", "a"): 0.9})
    assert level[1] > level[0] and sorted(level.tolist()) == [0, 1, 2]
    assert group_order([], np.empty(0), w)[0].tolist() == []


def test_untimed_rows_take_their_place(spark):
    learn = [(g, [k], D(2024, 1, d), 0) for g in range(5) for d, k in enumerate(("draft", "final", "fixed"), 1)]
    rows = learn + [(7, ["draft"], D(2024, 3, 3), 1), (7, ["final"], None, 2), (7, ["fixed"], None, 3), (8, ["fixed"], D(2024, 3, 3), 4), (8, ["draft"], None, 5), (6, ["draft"], None, 6), (6, ["final"], None, 7)]
    got = {r.n: (r.current, r.follows, r.level) for r in with_currency(spark.createDataFrame(rows, KINDS), "kinds", "t").where("n > 0").collect()}
    day = got[1][0]
    assert got == {1: (day, 0, 0), 2: (day, 1, 1), 3: (day, 1, 2), 4: (day, 0, 0), 5: (None, 0, 0), 6: (None, 0, 0), 7: (None, 0, 1)}


def test_currency_decides_where_times_are_missing(spark):
    """Articles come as a bare number first, then with a prefix, then flagged; of every third article the last row has lost its time."""
    rows, want = [], {}
    for g in range(60):
        base, n = 10 * g + 1, str(1000 + g)
        lost = g % 3 == 0
        rows += [
            (base, f"tar://good.tar!/{g}.xml", n, None, "", "same", None, D(2024, 1, 1)),
            (base + 1, f"tar://good.tar!/{g}.v2.xml", f"PMID: {n}", None, "T", "same", False, D(2024, 2, 1)),
            (base + 2, f"tar://good.tar!/{g}.v3.xml", f"PMID: {n}", None, "U", "same", True, None if lost else D(2024, 3, 1)),
        ]
        want[base] = base + 2
    papers, tars = frame(spark, rows)
    got = {r.group_id: (r.pmid_from, r.title_from, r.in_index_from, r.abstract_from) for r in best_sources(papers, tars).collect()}
    assert got == {g: (x, x, x, x) for g, x in want.items()}
    # without the learned order the rows that lost their time would come last
    flat = {r.group_id: r.title for r in best_papers(papers, tars).collect()}
    assert set(flat.values()) == {"U"}


def test_hot_group(spark):
    rows = [(i, "tar://good.tar!/a.xml", "77" if i % 2 else "PMID: 77", None, "T" if i % 3 else "", "a" * (i % 50), None, None if i % 5 else D(2024, 1, 1)) for i in range(1, 3001)]
    r = best_papers(*frame(spark, rows)).collect()
    assert len(r) == 1 and r[0].n_rows == 3000 and len(r[0].abstract) == 49


def test_many_archives(spark):
    rows = [(i, f"tar://t{i % 300}.tar!/{i // 2}.xml", str(1 + i // 2), None, "T", "x", None, None if i % 7 == 0 else D(2024, 1, 1 + i % 28)) for i in range(1, 1201)]
    assert best_papers(*frame(spark, rows)).count() == 600 - 1
