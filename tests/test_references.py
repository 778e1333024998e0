from datetime import datetime as D

from pyspark.sql import functions as F

from tesserae.operators.references import orphan_rows, orphans_by_period, reference


def refs(spark, child, parent):
    c = spark.createDataFrame(child, "row_key string, ref string, at timestamp, parent string")
    p = spark.createDataFrame(parent, "key string, at timestamp, parent string")
    return [reference("c", "p", c, F.col("row_key"), F.col("ref"), F.col("at"), p, F.col("key"), F.col("at"))]


def test_late_never_null_and_repeats(spark):
    child = [("1", "a", D(2024, 1, 1), "x"), ("2", "a", D(2024, 3, 1), "x"), ("3", "zz", D(2024, 1, 5), "x"), ("4", None, D(2024, 1, 1), "x"), ("5", "", D(2024, 1, 1), "x"), ("6", "a", None, "x"), ("7", "zz", None, "x"), ("3", "zz", D(2024, 1, 5), "x"), ("8", "n", D(2020, 1, 1), "x"), ("9", "a", D(2024, 2, 1), "x")]
    parent = [("a", D(2024, 2, 1), "y"), ("a", D(2024, 5, 1), "y"), ("n", None, "y"), (None, D(2020, 1, 1), "y")]
    r = refs(spark, child, parent)
    got = sorted((x.row_key, x.missing) for x in orphan_rows(r).collect())
    assert got == [("1", "late"), ("3", "never"), ("3", "never"), ("7", "never")]
    per = {x.period: (x.orphans, x.never) for x in orphans_by_period(r).collect()}
    assert per == {"2024-01-01": (3, 2), None: (1, 1)}


def test_empty(spark):
    assert orphan_rows(refs(spark, [], [])).count() == 0
    assert orphan_rows(refs(spark, [("1", "a", D(2024, 1, 1), "x")], [])).count() == 1
