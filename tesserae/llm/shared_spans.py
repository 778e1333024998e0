"""Long exact spans that records of different owners share, by relative Lempel-Ziv parsing against reference blocks.

The reference is the collection itself, indexed in blocks. A block holds the texts around all places of one phrase: the
index takes from every text the phrases of k characters that are the least in some window of the wanted length, so any
span of that length has a phrase of the index, the same one wherever the span stands. A document is parsed against each
block that has one of its phrases with another owner; in the others no factor can reach the length.

The parse is greedy. A factor begins at the first position whose next characters stand in a block's text of another
owner, and is the longest match from there: the places where it may be copied from are sorted by what follows, and the
neighbours of another owner in that order hold the longest. Its characters are compared, and it has a source: record
and position. The parse then goes on at the factor's end; there it looks back over the boundary by less than the length,
so that a match which the boundary would cut is a factor as well. Factors of all blocks meet again per document, where
those that touch or overlap become one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._arrays import code_points, gram_hashes, slices, sliding
from tesserae.session import materialize

_BIG = np.int64(np.iinfo(np.int64).max)


def _inside(off: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first n positions begin a stretch of size characters that stays inside its text."""
    d = np.zeros(n + size + 2, np.int32)
    lens = np.diff(off)
    ok = lens >= size
    np.add.at(d, off[:-1][ok], 1)
    np.add.at(d, off[1:][ok] - size + 1, -1)
    return np.cumsum(d[:n]) > 0


def phrases(texts: list[str], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the phrases to index: the least of each window of length characters, ties included."""
    parts = []
    w = length - k + 1
    for a, b in slices(texts):
        codes, off = code_points(texts[a:b])
        if len(codes) < length:
            continue
        h = gram_hashes(codes, k)
        least = sliding(np.minimum, h, w)
        least = np.where(_inside(off, length, len(least)), least, np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        reach = sliding(np.maximum, np.concatenate([pad, least, pad]), w)
        at = np.flatnonzero((reach == h) & (h > 0))
        parts.append((np.searchsorted(off, at, "right") - 1 + a, at - off[np.searchsorted(off, at, "right") - 1], h[at].view(np.int64)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    t, p, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return t, p, h


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def _phrase_owners(length: int, k: int):
    """(phrase, low, high) of each batch: phrases with their least and greatest owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            owner = rb.column(1).to_numpy(zero_copy_only=False)
            t, _, h = phrases(rb.column(2).to_pylist(), length, k)
            if len(h):
                o = np.argsort(h, kind="stable")
                h, own = h[o], owner[t[o]]
                r = _runs(h)
                yield pa.RecordBatch.from_arrays([pa.array(h[r]), pa.array(np.minimum.reduceat(own, r)), pa.array(np.maximum.reduceat(own, r))], names=["phrase", "low", "high"])

    return run


def _phrase_places(length: int, k: int):
    """(phrase, id, pos) of each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            t, p, h = phrases(rb.column(2).to_pylist(), length, k)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[t]), pa.array(p.astype(np.int32))], names=["phrase", "id", "pos"])

    return run


def _surroundings(length: int, k: int):
    """(phrase, id, owner, chars, begin, around): the text around each phrase that a span through it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, owner, text, places in zip(*(rb.column(c).to_pylist() for c in range(4)), strict=True):
                for s in places:
                    begin = max(0, s["pos"] - (length - k))
                    for x, v in zip(out, (s["phrase"], i, owner, len(text), begin, text[begin : s["pos"] + length]), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["phrase", "id", "owner", "chars", "begin", "around"])

    return run


def _windows(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of every stretch of length characters inside the texts."""
    codes, off = code_points(texts)
    if len(codes) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(codes, length)
    at = np.flatnonzero(_inside(off, length, len(h)))
    t = np.searchsorted(off, at, "right") - 1
    return t, at - off[t], h[at].view(np.int64)


_FACTOR = "id long, chars int, begin int, end int, source long, source_begin int"
_PAD = np.uint32(0xFFFFFFFF)


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, index): the indexes first, first + 1, ... of size entries each."""
    which = np.repeat(np.arange(len(first)), size)
    return which, np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(first) else first, size) + np.arange(len(which))


def _longest(codes: np.ndarray, at: np.ndarray, room: np.ndarray, owner: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(match, source): for each place the longest match with a place of another owner in its group, 0 if there is none.

    All places of a group agree in their next length characters, as far as their hashes say; room is what a text holds
    from the place on. Each group has several owners.
    """
    wide = int(room.max()) - length
    col = np.arange(max(wide, 0))
    more = np.full((len(at), len(col)), _PAD, np.uint32)
    inside = col[None, :] < (room - length)[:, None]
    more[inside] = codes[(at + length)[:, None] + col[None, :]][inside] if len(codes) > int((at + length).max()) + len(col) else np.take(codes, (at + length)[:, None] + col[None, :], mode="clip")[inside]
    key = np.empty((len(at), len(col) + 3), ">u4")
    key[:, 0], key[:, 1], key[:, 2:-1], key[:, -1] = group >> 32, group & 0xFFFFFFFF, more, 1
    o = np.argsort(key.view(f"S{4 * key.shape[1]}").ravel(), kind="stable")
    g, w, more, room_o = group[o], owner[o], more[o], room[o]
    edge = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
    run = np.cumsum(edge) - 1
    first = np.flatnonzero(edge)
    before, after = first[run] - 1, np.append(first[1:], len(o))[run]
    match, source = np.zeros(len(o), np.int64), np.full(len(o), -1, np.int64)
    here = np.arange(len(o))
    for other in (before, after):
        ok = (other >= 0) & (other < len(o))
        ok[ok] &= g[other[ok]] == g[ok]
        i, j = here[ok], other[ok]
        if not len(i):
            continue
        differ = more[i] != more[j]
        common = np.where(differ.any(1), differ.argmax(1), len(col)) if len(col) else np.zeros(len(i), np.int64)
        m = length + np.minimum(common, np.minimum(room_o[i], room_o[j]) - length)
        better = m > match[i]
        match[i[better]], source[i[better]] = m[better], o[j[better]]
    out, of = np.empty_like(match), np.empty_like(source)
    out[o], of[o] = match, source
    return out, of


def parse(texts: list[str], owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, begin, size, source, source_begin) of the factors of each text against the texts of other owners."""
    codes, off = code_points(texts)
    t, start, h = _windows(texts, length)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if not len(h):
        return none
    _, group = np.unique(h, return_inverse=True)
    low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, owner[t])
    np.maximum.at(high, group, owner[t])
    hit = low[group] != high[group]
    t, start, group = t[hit], start[hit], group[hit]
    if not len(t):
        return none
    at = off[t] + start
    room = off[t + 1] - at
    by = np.argsort(group, kind="stable")
    of_group = np.searchsorted(group[by], np.arange(group.max() + 2))
    head = _runs(t)  # the first place of each text
    out = []
    while len(head):
        some = np.unique(group[head])
        which, place = _spread(of_group[some], of_group[some + 1] - of_group[some])
        place = by[place]
        match, source = np.zeros(len(t), np.int64), np.full(len(t), -1, np.int64)
        step = 1 << 15
        cuts = np.searchsorted(which, np.unique(which[::step])) if len(which) > step else np.zeros(1, np.int64)
        for x, y in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
            p = place[x:y]
            m, f = _longest(codes, at[p], room[p], owner[t[p]], group[p], length)
            match[p], source[p] = m, np.where(f >= 0, p[f], -1)
        # hashes only proposed the source: the characters decide
        src = np.maximum(source[head], 0)
        same = (codes[at[head][:, None] + np.arange(length)] == codes[at[src][:, None] + np.arange(length)]).all(1) & (source[head] >= 0)
        got = head[same]
        out.append(np.stack([t[got], start[got], match[got], t[source[got]], start[source[got]]]))
        # on behind the factor, but back over its boundary; after a false proposal just one on
        nxt = np.searchsorted(at, at[head] + np.where(same, match[head] - length, 0), side="right")
        live = nxt < len(t)
        live[live] &= t[nxt[live]] == t[head[live]]
        head = nxt[live]
    return tuple(np.concatenate(out, axis=1))


def _parse_blocks(length: int):
    """Parse within sorted blocks: rows of one phrase follow each other, some thousands at most."""

    def factors(rows: pa.Table) -> pa.RecordBatch:
        t, begin, size, of, of_begin = parse(rows.column("around").to_pylist(), rows.column("owner").to_numpy(), length)
        ids, first = rows.column("id").to_numpy(), rows.column("begin").to_numpy()
        begin = first[t] + begin
        cols = [ids[t], rows.column("chars").to_numpy()[t], begin, begin + size, ids[of], first[of] + of_begin]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(cols, kinds, strict=True)], names=["id", "chars", "begin", "end", "source", "source_begin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 2000:
                continue
            key = held.column("phrase").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last phrase may go on
            at = 0
            while at < whole:
                to = min(whole, at + 2000)
                to = int(np.searchsorted(key[:whole], key[to - 1], "right"))
                yield factors(held.slice(at, to - at))
                at = to
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield factors(held)

    return run


def _loose_windows(length: int):
    """(window, phrase, around, low, high, start) of every stretch of the distinct surroundings of crowded phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                rows = pa.Table.from_batches([whole.slice(k, 2000)])
                t, start, h = _windows(rows.column("text").to_pylist(), length)
                cols = [pa.array(h)] + [pa.array(rows.column(c).to_numpy()[t]) for c in ("phrase", "around", "low", "high")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(start.astype(np.int32))], names=["window", "phrase", "around", "low", "high", "start"])

    return run


def _spans(factors: DataFrame) -> DataFrame:
    """(id, spans, shared_chars, share): factors that touch or overlap at their boundaries are one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, chars, lists = (rb.column(c).to_pylist() for c in range(3))
            spans, total = [], []
            for fs in lists:
                out: list[list[int]] = []
                for f in sorted((f["begin"], f["end"]) for f in fs):
                    if out and f[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], f[1])
                    else:
                        out.append(list(f))
                spans.append([{"begin": a, "end": b} for a, b in out])
                total.append(sum(b - a for a, b in out))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind), pa.array(total, pa.int32()), pa.array([round(a / b, 6) for a, b in zip(total, chars, strict=True)], pa.float64())], names=["id", "spans", "shared_chars", "share"])

    per = factors.groupBy("id").agg(F.max("chars").alias("chars"), F.collect_set(F.struct("begin", "end")).alias("f"))
    return per.mapInArrow(run, "id long, spans array<struct<begin:int,end:int>>, shared_chars int, share double")


def shared_spans(df: DataFrame, key: str, owner: str, text: str, length: int = 160, k: int = 48, crowd: int = 4096) -> DataFrame:
    """(id, spans, shared_chars, share) of the rows of df that share length or more characters with another owner's row.

    The spans are the factors of relative Lempel-Ziv parsing, see factors, put together where they touch or overlap:
    [begin, end) in code points, maximal and apart; share is the part of the text that they cover.
    """
    return _spans(factors(df, key, owner, text, length, k, crowd))


def factors(df: DataFrame, key: str, owner: str, text: str, length: int = 160, k: int = 48, crowd: int = 4096) -> DataFrame:
    """(id, chars, begin, end, source, source_begin): factors of length characters or more that are copied from another owner's row.

    id and source are the key (long, one row each), owner a long; [begin, end) in code points, chars the text's length.
    The source is one of several where more hold as long a match, and null for crowded phrases.
    Rows with a null key, owner or text take no part, nor do texts shorter
    than length; rows of the same owner never count against each other; an empty table gives no rows. Repeated rows of
    a key under one owner count once. Factors are compared character by character; of crowded phrases (below), by
    64-bit hashes.

    Scale: the owners of each phrase are combined within each batch and again before the shuffle; only phrases of
    several owners are joined back to their places, whose hot phrases adaptive execution can split; only texts with
    such a phrase are read in full. Copies of a text are two texts to the parse at most. Blocks hold up to crowd texts a phrase. Of a phrase of more texts than that each
    distinct surrounding is looked at once and goes by its windows, with the same combining and joining, so no group is
    ever gathered in one task and a crowd of copies costs little more than its places.
    """
    if not 8 <= k <= length:
        raise ValueError("k must be from 8 to length")
    src = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{owner}`").cast("long").alias("owner"), F.col(f"`{text}`").alias("text"))
    src = src.where(f"id IS NOT NULL AND owner IS NOT NULL AND char_length(text) >= {length}")
    owners = src.mapInArrow(_phrase_owners(length, k), "phrase long, low long, high long")
    index = owners.groupBy("phrase").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("phrase")
    places = src.mapInArrow(_phrase_places(length, k), "phrase long, id long, pos int").join(index, "phrase")
    members, idle = _copies(src)
    wanted = places.groupBy("id").agg(F.collect_set(F.struct("phrase", "pos")).alias("places")).join(idle, "id", "left_anti")
    around = src.join(wanted, "id").select("id", "owner", "text", "places")
    around = around.mapInArrow(_surroundings(length, k), "phrase long, id long, owner long, chars int, begin int, around string")
    found = _parse(around, length, crowd)
    if not members.limit(1).count():
        return found
    # copies whose owners differ are shared as a whole; those of one owner have the factors of the one that was parsed
    whole = members.where("low <> high").select("id", "chars", F.lit(0).alias("begin"), F.col("chars").alias("end"), F.when(F.col("owner") != F.col("low"), F.col("first")).otherwise(F.col("last")).alias("source"), F.lit(0).alias("source_begin"))
    follow = members.where("low = high AND id <> first").select(F.col("id").alias("copy"), "first")
    found = materialize(found)
    same = follow.join(found, F.col("first") == F.col("id")).select(F.col("copy").alias("id"), "chars", "begin", "end", "source", "source_begin")
    return found.unionByName(whole).unionByName(same)


def _copies(src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, owner, chars, low, first, high, last) of texts that occur more than once, and the ids (id) that need no parse.

    Texts are told apart by 128 bits of hashes and their length. Of the copies of a text the one of the least owner
    (first) and the one of the greatest (last) stand for all others: whatever owner another text has, one of them
    differs. So a crowd of copies of any size is two texts to the parse; only ids and hashes are shuffled here.
    """
    text = src.select("id", "owner", F.char_length("text").alias("chars"), F.xxhash64("text").alias("c0"), F.xxhash64(F.lit(1), "text").alias("c1"))
    key = ["c0", "c1", "chars"]
    several = text.groupBy(*key).agg(F.min(F.struct("owner", "id")).alias("lo"), F.max(F.struct("owner", "id")).alias("hi"), F.count("*").alias("n")).where("n > 1")
    members = materialize(text.join(several, key).select("id", "owner", "chars", F.col("lo.owner").alias("low"), F.col("lo.id").alias("first"), F.col("hi.owner").alias("high"), F.col("hi.id").alias("last")).distinct())
    return members, members.where("id <> first AND NOT (low <> high AND id = last)").select("id").distinct()


def _parse(around: DataFrame, length: int, crowd: int) -> DataFrame:
    """Factors of the texts around phrases; those of crowded phrases by their windows."""
    around = materialize(around)
    crowded = materialize(around.groupBy("phrase").count().where(F.col("count") > crowd).select("phrase"))
    some = crowded.limit(1).count() > 0
    # broadcast, and few: one phrase for crowd rows or more. Joined by a shuffle, the repartition below would be left out as
    # done already, and adaptive execution may then read that shuffle by its writers or split it, and tear phrases apart
    crowded = F.broadcast(crowded)
    few = (around.join(crowded, "phrase", "left_anti") if some else around).repartition("phrase").sortWithinPartitions("phrase").mapInArrow(_parse_blocks(length), _FACTOR)
    if not some:
        return few
    # a crowd is mostly alike: each distinct surrounding is looked at once, with the range of its owners
    many = around.join(crowded, "phrase").withColumn("text", F.col("around")).withColumn("around", F.xxhash64("text"))
    once = many.groupBy("phrase", "around").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.any_value("text").alias("text"))
    loose = once.select("phrase", "around", "low", "high", "text").mapInArrow(_loose_windows(length), "window long, phrase long, around long, low long, high long, start int")
    mixed = loose.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("window")
    hits = loose.join(mixed, "window").groupBy("phrase", "around").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    # runs of starts: where a start does not follow the one before, a factor begins
    begins = F.filter("starts", lambda x: ~F.array_contains(F.col("starts"), x - 1))
    ends = F.filter("starts", lambda x: ~F.array_contains(F.col("starts"), x + 1))
    runs = hits.select("phrase", "around", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("r"))
    at = F.col("begin")
    loose = many.select("phrase", "around", "id", "chars", "begin").join(runs, ["phrase", "around"]).select("id", "chars", (at + F.col("r.a")).alias("begin"), (at + F.col("r.b") + length).alias("end"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("source_begin"))
    return few.unionByName(loose)
