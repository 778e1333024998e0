"""Parameters of the vector indexes, from the size of the data. Each is a column expression over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pick_nprobe(nlist: Column | int, user: Column | int | None = None) -> Column:
    """Lists to probe: the user's number or the root of nlist, at least 8 (32 from 16,384 lists on), at most 512
    (1024 from 65,536 on), never more than there are."""
    n = _c(nlist)
    target = F.floor(F.sqrt(F.greatest(n, F.lit(1)))).cast("int")
    if user is not None:
        target = F.coalesce(_c(user).cast("int"), target)
    low = F.when(n >= 16384, 32).otherwise(8)
    high = F.when(n >= 65536, 1024).otherwise(512)
    return F.least(n.cast("int"), F.greatest(low, F.least(high, target)))


def auto_nprobe(nlist: Column | int, user: Column | int | None = None, low: int = 8, high: int = 512) -> Column:
    """pick_nprobe, held within [low, high] once more."""
    return F.greatest(F.lit(low), F.least(F.lit(high), pick_nprobe(nlist, user)))


def safe_pq_m(dim: Column | int, wanted: Column | int) -> Column:
    """The largest divisor of dim that is at most wanted."""
    d, m = _c(dim), _c(wanted)
    return F.array_max(F.filter(F.sequence(F.lit(1), m), lambda x: d % x == 0)).cast("int")


def effective_nlist(n_train: Column | int, wanted: Column | int, least: int = 16, forced: bool = False) -> Column:
    """Lists for so many training vectors: at most wanted, n_train and 4 roots of it; at least least, or 128 from
    100,000 vectors on unless the number was forced."""
    n, w = _c(n_train), _c(wanted)
    by_root = F.least(n, F.greatest(F.lit(1), F.floor(4 * F.sqrt(n)).cast("int")))
    floor = F.lit(least) if forced else F.when(n >= 100_000, 128).otherwise(least)
    floor = F.least(n, F.greatest(F.lit(1), floor))
    return F.when(n <= 0, 0).otherwise(F.greatest(floor, F.least(w, n, by_root))).cast("int")


def ivf_plan(n_train: Column | int, dim: int, nlist: Column | int, pq_m: int, bits: int = 8) -> Column:
    """struct(kind, nlist, m): 'ivfpq', or 'flat' where the training vectors are too few for lists or codes."""
    n = _c(n_train)
    m = safe_pq_m(dim, pq_m)
    least = 39 * (1 << bits)
    lists = F.least(effective_nlist(n, nlist), F.greatest(F.lit(1), F.floor(n / 40).cast("int")))
    few = (n < F.greatest(F.lit(256), F.lit(least), 100 * m)) | (lists < 8) | (n < 50 * lists)
    return F.struct(F.when(few, "flat").otherwise("ivfpq").alias("kind"), F.when(few, 0).otherwise(lists).cast("int").alias("nlist"), F.when(few, 0).otherwise(m).cast("int").alias("m"))


def safe_ivfpq(n_samples: Column | int, dim: int, nlist: Column | int, pq_m: int, bits: int = 8) -> Column:
    """struct(nlist, m, use_flat): flat below 39 samples a code; otherwise a list for every 39 samples at most."""
    n = _c(n_samples)
    flat = n < 39 * (1 << bits)
    lists = F.greatest(F.lit(1), F.least(_c(nlist), F.floor(n / 39).cast("int")))
    return F.struct(F.when(flat, 0).otherwise(lists).cast("int").alias("nlist"), F.when(flat, 0).otherwise(safe_pq_m(dim, pq_m)).cast("int").alias("m"), flat.alias("use_flat"))


def top_papers(n_papers: Column | int) -> Column:
    """Papers to shortlist for a corpus of that size."""
    n = _c(n_papers)
    return F.when(n < 50_000, 500).when(n < 500_000, 1000).when(n < 2_000_000, 2000).otherwise(4000)
