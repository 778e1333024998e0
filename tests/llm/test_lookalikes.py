from tesserae.llm.lookalikes import consistent_text

CASES = [
    ("wide Ａ１x", "wide A1x"),
    ("ﬁbre aﬃnity", "fibre affinity"),
    ("\U0001d41a\U0001d7cf", "a1"),
    ("Ñorrea and Ñorrea", "Ñorrea and Ñorrea"),
    ("soft­hyphen zero​width ﻿mark", "softhyphen zerowidth mark"),
    ("no break em", "no break em"),
    ("pοοrly рluѕ DΑMΑ-1", "poorly plus DAMA-1"),
    ("IFN-γ LWSA6Rα 5 μm", None),
    ("10⁶ H₂O a–b “q” café", None),
    ("Институт сор 論文", None),
    ("\U0001f468‍\U0001f469", None),
    ("x̄ mean", None),
    ("celլ ցene Ꭺnna ꓮnna ɡene Ԍene", "cell gene Anna Anna gene Gene"),
    ("a\u3164b\u2800c\u2028d", "a b c d"),
    ("x\ufe0fy z\U000e0041", "xy z"),
    ("❤\ufe0f 1\ufe0f\u20e3 \U0001f3f4\U000e0067\U000e007f", None),
    ("𝐜𝐞𝐥𝐥ѕ ａ\u0301 Ⓐⓑ K ﬀ ﬃ ﬆ 🄰", "cells á Ab K ff ffi st A"),
    ("e\u0302\u0301 ê\u0301 \u00f1 n\u0303\u00e9", "ế ế ñ ñé"),
    ("и\u0306 α\u0301", "й ά"),
    ("Հայ ᏣᎳᎩ ꓡꓲꓢꓴ", None),
    ("", None),
    (None, None),
]


def test_forms(spark):
    rows = [(i, t, "other") for i, (t, _) in enumerate(CASES)] * 2
    got = consistent_text(spark.createDataFrame(rows, "id long, text string, changed2 string"), "text").collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.id][1]
        assert (r.form, r.changed) == ((CASES[r.id][0], False) if want is None else (want, True)), r


def test_form_is_its_own_form_and_names(spark):
    rows = [(t, f, 7) for t, f in CASES if f]
    df = spark.createDataFrame(rows, "text string, form string, changed int")
    once = consistent_text(df, "text").select("form")
    again = consistent_text(once.withColumnRenamed("form", "text"), "text").collect()
    assert not any(r.changed for r in again)


def test_empty(spark):
    assert consistent_text(spark.createDataFrame([], "text string"), "text").columns == ["text", "form", "changed"]
    assert consistent_text(spark.createDataFrame([], "text string"), "text").count() == 0
