"""One surviving record for each group of duplicate records, field by field.

Groups are connected components over shared keys. Fields are ranked by trust, currency and completeness. Currency is
the time of a row where it has one. Where it has none, currency reasoning gives it a place: the kinds of a row's values
(how an identifier is written, whether there is a title, the flag, the version of the member) follow one another in
time, and how they do is learned from the rows that have times; with that every group with untimed rows gets a partial
order of its own, from times where both sides have them and from the learned transitions elsewhere, and an untimed row
counts as later than all that come before it in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.components import components
from tesserae.session import materialize


def identifier(c: Column) -> Column:
    """The number of an identifier however it is written; null for placeholders, a single zero among them.

    The first run of digits counts, so prefixes, versions and decimal endings do not.
    """
    digits = F.regexp_replace(F.regexp_extract(c, r"(\d+)", 1), "^0+", "")
    return F.when(digits != "", digits)


#: Versions from this on are one kind, which bounds the kinds of a field.
MOST_VERSIONS = 20


def written(c: Column) -> Column:
    """How an identifier is written: none, word (a placeholder), bare, decimal or dressed (with letters or spaces around)."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.trim(t) == "", "none").when(identifier(t).isNull(), "word").when(t.rlike(r"^\d+$"), "bare").when(t.rlike(r"^\d+\.\d+$"), "decimal").otherwise("dressed")


def paper_kinds() -> Column:
    """array<string>: the kinds of a paper's values, one of each field, each of a few."""
    version = F.coalesce(F.regexp_extract("doc_id", r"\.v(\d+)\.[^./]*$", 1).try_cast("int"), F.lit(1))
    flag = F.coalesce(F.col("in_index").cast("string"), F.lit("null"))
    there = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "none").otherwise("some")
    return F.array(written(F.col("pmid")), written(F.col("pmcid")), there("title"), there("abstract"), flag, F.least(version, F.lit(MOST_VERSIONS)).cast("string"))


def learn_transitions(rows: DataFrame, group: str, kinds: str, at: str) -> dict[tuple[int, str, str], float]:
    """(field, a, b) -> weight from 0 to 1: how surely a value of kind b is later than one of kind a.

    rows: group, kinds (array<string>, a kind of each field), at (timestamp or null). A group in which kind a begins and
    ends before b speaks for a before b; the weight is the surplus of such groups by all that speak either way. Rows
    of a group are combined to the first and last time of each kind before any are brought together, so an entry has
    as many members as a field has kinds; and so many are the squares of kinds that reach the driver.
    """
    timed = rows.where(F.col(at).isNotNull()).select(group, at, F.posexplode(kinds).alias("field", "kind"))
    spans = timed.groupBy(group, "field", "kind").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    lists = spans.groupBy(group, "field").agg(F.collect_list(F.struct("kind", "lo", "hi")).alias("k")).where("size(k) > 1")
    pairs = lists.select("field", "k", F.explode("k").alias("a")).select("field", "a", F.explode("k").alias("b")).where("a.lo < b.lo AND a.hi < b.hi")
    n = {(r.field, r.a, r.b): r.n for r in pairs.groupBy("field", F.col("a.kind").alias("a"), F.col("b.kind").alias("b")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for (f, a, b), m in n.items():
        back = n.get((f, b, a), 0)
        if m > back:
            out[f, a, b] = (m - back) / (m + back)
    return out


def group_order(kinds: list[tuple[str, ...]], last: np.ndarray, weights: dict[tuple[int, str, str], float]) -> tuple[np.ndarray, np.ndarray]:
    """(level, after) of the members of one group: place in its partial order, and the latest time that comes before it.

    A member stands for all rows of the same kinds; last is its latest time, NaN for untimed ones. Of two timed members
    the earlier comes first; elsewhere the learned weights of all fields decide together, and members that they do not
    tell apart are not ordered. The order is taken apart from the bottom; where a circle leaves no lowest member the
    one with the least weight below it goes first and what pointed to it is dropped.
    """
    n = len(kinds)
    below = np.zeros((n, n))  # below[x, y]: how surely x comes before y
    for f in range(len(kinds[0]) if n else 0):
        seen, at = np.unique([k[f] for k in kinds], return_inverse=True)
        w = np.asarray([[weights.get((f, a, b), 0.0) for b in seen] for a in seen])
        below += w[at][:, at]
    below = np.maximum(below - below.T, 0)
    timed = ~np.isnan(last)
    both = timed[:, None] & timed[None, :]
    with np.errstate(invalid="ignore"):
        below = np.where(both, (last[:, None] < last[None, :]).astype(float) * 1e6, below)
    level, after, open_ = np.zeros(n, np.int64), np.full(n, -np.inf), np.ones(n, bool)
    while open_.any():
        load = np.where(open_, below[open_].sum(0), np.inf)
        x = int(load.argmin())
        open_[x] = False
        held = (~open_) & (below[:, x] > 0)
        if held.any():
            level[x] = level[held].max() + 1
            after[x] = np.maximum(after[held], np.where(timed[held], last[held], -np.inf)).max()
    return level, after


def _orders(weights: dict[tuple[int, str, str], float]):
    """(group_id, sig, level, after) from (group_id, members array<struct<sig, kinds, last>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for g, members in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                members.sort(key=lambda m: m["sig"])
                last = np.asarray([np.nan if m["last"] is None else m["last"] for m in members], np.float64)
                level, after = group_order([tuple(m["kinds"]) for m in members], last, weights)
                for x, v in zip(out, ([g] * len(members), [m["sig"] for m in members], level.tolist(), [None if np.isinf(a) else int(a) for a in after]), strict=True):
                    x += v
            yield pa.RecordBatch.from_arrays([pa.array(out[0], rb.schema.field(0).type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["group_id", "sig", "level", "after"])

    return run


def with_currency(rows: DataFrame, kinds: str, at: str) -> DataFrame:
    """rows (group_id, kinds, at and more) with current (long, microseconds), follows (0 or 1) and level (long).

    current is a row's time or, where it has none, the latest time that comes before it in its group's partial order,
    with follows 1, since it comes after that; null if nothing timed does. level is an untimed row's place in that
    order, 0 for timed ones. So the latest row has the greatest (current, follows, level).
    """
    rows = rows.withColumn("sig", F.concat_ws("|", kinds)).withColumn("at", F.unix_micros(F.col(at).cast("timestamp")))
    bare = rows.where("at IS NULL")
    timed = rows.where("at IS NOT NULL").withColumns({"current": F.col("at"), "follows": F.lit(0), "level": F.lit(0).cast("long")})
    if not bare.limit(1).count():
        return timed.drop("sig", "at")
    weights = learn_transitions(rows, "group_id", kinds, at)
    members = rows.join(bare.select("group_id").distinct(), "group_id", "left_semi").groupBy("group_id", "sig").agg(F.first(kinds).alias("kinds"), F.max("at").alias("last"))
    # untimed rows of the kinds of timed ones share their place
    order = members.groupBy("group_id").agg(F.collect_list(F.struct("sig", "kinds", "last")).alias("members")).mapInArrow(_orders(weights), rows.select("group_id").schema.add("sig", "string").add("level", "long").add("after", "long"))
    own = members.select("group_id", "sig", "last").join(order, ["group_id", "sig"])
    placed = bare.join(own, ["group_id", "sig"]).withColumns({"current": F.greatest("last", "after"), "follows": (F.col("last").isNull() & F.col("after").isNotNull()).cast("int")})
    return timed.unionByName(placed.drop("last", "after")).drop("sig", "at")


def papers_in_groups(papers: DataFrame, tars: DataFrame) -> DataFrame:
    """Rows of articles that occur more than once, without their texts: group_id, parsed identifiers, trust, currency.

    papers: paper_id, doc_id, pmid, pmcid, title, abstract, in_index, loaded_at; other columns are left behind.
    A member of a tar that tars does not know ranks behind all that it knows, no doc_id last. row is a hash of the
    stored row, which tells repeated ids apart.
    """
    p = _stored(papers)
    keys = p.select(
        F.col("paper_id").alias("id"),
        F.explode(F.array_compact(F.array(F.concat(F.lit("p"), identifier(F.col("pmid"))), F.concat(F.lit("c"), identifier(F.col("pmcid"))), F.when(F.col("doc_id") != "", F.concat(F.lit("d"), F.col("doc_id")))))).alias("key"),
    )
    groups = components(keys)
    trust = tars.groupBy("tar").agg(F.min("trust").alias("trust"))
    lean = p.select(
        "paper_id",
        "row",
        "in_index",
        "loaded_at",
        identifier(F.col("pmid")).alias("pmid"),
        identifier(F.col("pmcid")).alias("pmcid"),
        F.char_length("abstract").alias("n"),
        (F.trim("title") != "").alias("titled"),
        (F.col("doc_id") != "").alias("placed"),
        paper_kinds().alias("kinds"),
        F.regexp_extract("doc_id", "^tar://(.*?)!/", 1).alias("tar"),
    )
    rows = lean.join(groups, F.col("paper_id") == F.col("id")).drop("id").join(trust, "tar", "left").drop("tar")
    rows = rows.withColumn("trust", F.when(F.coalesce("placed", F.lit(False)), F.coalesce("trust", F.lit(2**31 - 2))).otherwise(F.lit(2**31 - 1)))
    return with_currency(materialize(rows), "kinds", "loaded_at")


def _stored(papers: DataFrame) -> DataFrame:
    p = papers.select("paper_id", "doc_id", "pmid", "pmcid", "title", "abstract", "in_index", "loaded_at").where("paper_id IS NOT NULL")
    return p.withColumn("row", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in p.columns]))


def sources(papers: DataFrame, tars: DataFrame) -> DataFrame:
    """(group_id, n_rows, and of each field the struct id, row, v of the row that supplies it) of the articles with two rows or more.

    Rows rank by trust, then the latest (current, follows, level), then smallest paper_id. pmid, pmcid, title and
    doc_id come from the first row that has one, the abstract from the row with the longest, in_index from the latest
    row that says so. Every choice is the minimum of a struct, so a group of any size is combined before the shuffle.
    """
    rows = papers_in_groups(papers, tars)
    late = [(-F.coalesce("current", F.lit(-(2**62)))).alias("b"), (-F.col("follows")).alias("c"), (-F.col("level")).alias("d")]
    last = [F.col("paper_id").alias("id"), F.col("row").alias("row")]
    rank = [F.col("trust").cast("long").alias("a"), *late, *last]

    def pick(has: Column, value: Column, *order: Column) -> Column:
        return F.min(F.when(has, F.struct(*order, value.alias("v"))))

    return rows.groupBy("group_id").agg(
        F.count("*").alias("n_rows"),
        pick(F.col("pmid").isNotNull(), F.col("pmid"), *rank).alias("pmid"),
        pick(F.col("pmcid").isNotNull(), F.col("pmcid"), *rank).alias("pmcid"),
        pick(F.col("n") > 0, F.lit(None).cast("string"), (-F.col("n")).alias("n"), *rank).alias("abstract"),
        pick(F.col("titled"), F.lit(None).cast("string"), *rank).alias("title"),
        pick(F.col("placed"), F.lit(None).cast("string"), *rank).alias("doc_id"),
        pick(F.col("in_index").isNotNull(), F.col("in_index"), *late, *last).alias("in_index"),
    )


FIELDS = ("pmid", "pmcid", "abstract", "title", "doc_id", "in_index")


def _from(f: str) -> Column:
    return F.coalesce(F.col(f"{f}.id"), F.lit(0).cast("long")).alias(f"{f}_from")


def best_sources(papers: DataFrame, tars: DataFrame) -> DataFrame:
    """(group_id, n_rows, pmid_from, ...): the paper_id that supplies each field, 0 if no row has it."""
    return sources(papers, tars).select("group_id", "n_rows", *map(_from, FIELDS))


def best_papers(papers: DataFrame, tars: DataFrame) -> DataFrame:
    """One row for each article with two or more rows in papers.

    group_id; pmid, pmcid (numbers), abstract, title, in_index, doc_id, and for each the paper_id that supplies it
    (0 if no row has it; doc_id_from for doc_id, ...); n_rows. See sources for the choice. Rows with a null paper_id
    take no part; repeated rows change nothing but n_rows; an empty table gives no rows. Texts are fetched for the
    chosen rows only.
    """
    chosen = materialize(sources(papers, tars))
    texts = ("abstract", "title", "doc_id")
    wanted = chosen.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{f}.id").alias("paper_id"), F.col(f"{f}.row").alias("row")) for f in texts])).alias("w")).where("w.paper_id IS NOT NULL").select("group_id", "w.*")
    store = _stored(papers).select("paper_id", "row", *texts).dropDuplicates(["paper_id", "row"])
    value = F.coalesce(*[F.when(F.col("f") == f, F.col(f)) for f in texts])
    got = wanted.join(store, ["paper_id", "row"]).groupBy("group_id").agg(*[F.max(F.when(F.col("f") == f, value)).alias(f"{f}_text") for f in texts])
    out = chosen.join(got, "group_id", "left")
    return out.select("group_id", "n_rows", *[(F.col(f"{f}_text") if f in texts else F.col(f"{f}.v")).alias(f) for f in FIELDS], *map(_from, FIELDS))
