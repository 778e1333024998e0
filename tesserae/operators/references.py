"""References between tables: orphans by row, by table and by period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` name ``ref`` that should be a ``key`` of ``parent``.

    child_rows: columns row_key (string), ref (any type castable to string), at (timestamp).
    parent_rows: columns key, at.
    """

    tbl: str
    parent: str
    child_rows: DataFrame
    parent_rows: DataFrame


def reference(tbl: str, parent: str, child: DataFrame, row_key: Column, ref: Column, at: Column, parents: DataFrame, key: Column, parent_at: Column) -> Reference:
    """Build a Reference from two tables; other columns, also of equal names, are left behind."""
    return Reference(
        tbl,
        parent,
        child.select(row_key.cast("string").alias("row_key"), ref.cast("string").alias("ref"), at.alias("at")),
        parents.select(key.cast("string").alias("key"), parent_at.alias("at")),
    )


def _long_form(refs: list[Reference]) -> DataFrame:
    """Parent and child keys of all references as tagged rows (parent, key, parent_at, child_at, unknown_at).

    Repeated uses of a parent table are read once.
    """
    parts, seen = [], set()
    for r in refs:
        if r.parent not in seen:
            seen.add(r.parent)
            parts.append(
                r.parent_rows.where((F.col("key") != "")).select(
                    F.lit(r.parent).alias("parent"),
                    "key",
                    # a parent whose time is unknown was there from the start
                    F.coalesce("at", F.lit("0001-01-01").cast("timestamp")).cast("timestamp").alias("parent_at"),
                    F.lit(None).cast("timestamp").alias("child_at"),
                )
            )
        parts.append(
            r.child_rows.where(F.col("ref") != "").select(
                F.lit(r.parent).alias("parent"),
                F.col("ref").alias("key"),
                F.lit(None).cast("timestamp").alias("parent_at"),
                F.coalesce("at", F.lit("9999-12-31").cast("timestamp")).cast("timestamp").alias("child_at"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suspect_keys(refs: list[Reference]) -> DataFrame:
    """(parent, key, first_at): keys that some child named before their first parent row, first_at null if none ever came.

    One aggregation over the union; both sides combine before the shuffle, so a key that a third
    of all rows name costs one row a task.
    """
    g = _long_form(refs).groupBy("parent", "key").agg(F.min("parent_at").alias("first_at"), F.min("child_at").alias("first_use"))
    return g.where(F.col("first_use").isNotNull() & (F.col("first_at").isNull() | (F.col("first_use") < F.col("first_at")))).select("parent", "key", "first_at")


def orphan_rows(refs: list[Reference]) -> DataFrame:
    """Child rows (tbl, row_key, ref, at, missing) whose reference had no parent row at or before their own time.

    missing: 'never' or 'late'. Null and empty references are none. A child whose time is null counts
    as loaded last (it is an orphan only if the parent never came), a parent whose time is null as
    loaded first. Repeated rows come out repeated; empty tables give no rows.

    The keys in question are found first; only they are joined back. The large side of that join is the
    child table, whose hot keys adaptive execution can split.
    """
    keys = suspect_keys(refs)
    out = None
    for r in refs:
        k = keys.where(F.col("parent") == r.parent).select(F.col("key").alias("ref"), "first_at")
        j = r.child_rows.where(F.col("ref") != "").join(k, "ref")
        j = j.where(F.col("first_at").isNull() | (F.col("at") < F.col("first_at")))
        j = j.select(F.lit(r.tbl).alias("tbl"), "row_key", "ref", "at", F.when(F.col("first_at").isNull(), "never").otherwise("late").alias("missing"))
        out = j if out is None else out.unionByName(j)
    return out


def orphans_by_period(refs: list[Reference], period: str = "month") -> DataFrame:
    """(tbl, period, orphans, never): orphan rows and distinct row keys by table and period of their own time.

    Rows without a time are reported under a null period.
    """
    return (
        orphan_rows(refs)
        .groupBy("tbl", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period"))
        .agg(F.count("*").alias("orphans"), F.sum((F.col("missing") == "never").cast("long")).alias("never"))
    )
