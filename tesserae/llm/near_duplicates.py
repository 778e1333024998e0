"""Records that share most of their word runs, by a chosen-path set similarity join.

Each record's set of word runs is hashed to a few root tokens, one for each independent tree, and to a sketch of least
hashes. Records with the same root token form a node. A small node is compared exhaustively by sketches. A large one
branches: some coordinates of the sketch, chosen by the node's own path, split it, and each record follows all of
them; so it goes on until nodes are small. A pair at the threshold meets in a tree with a known chance, and the trees
are as many as the wanted recall needs. Candidates are verified on the whole sets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._arrays import _powers, code_points, mix, slices
from tesserae.operators.components import components
from tesserae.session import materialize

SKETCH = 32
BRANCHES = 4
_WORD: np.ndarray | None = None


@dataclass(frozen=True)
class Join:
    """words: length of a run; threshold: least Jaccard similarity; least_words: shorter texts take no part;
    miss: accepted chance to miss a pair exactly at the threshold; leaf: nodes compared exhaustively;
    crowd: nodes beyond it branch across tasks."""

    words: int = 5
    threshold: float = 0.8
    least_words: int = 20
    miss: float = 1e-4
    leaf: int = 48
    crowd: int = 20_000

    @property
    def trees(self) -> int:
        meet = self.threshold * (1 - (1 - self.threshold) ** BRANCHES)
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - meet))) if meet < 1 else 1

    @property
    def agree(self) -> int:
        """Sketch coordinates that must agree: all but miss of the pairs at the threshold have as many."""
        p, below = self.threshold, 0.0
        for m in range(SKETCH + 1):
            below += math.comb(SKETCH, m) * p**m * (1 - p) ** (SKETCH - m)
            if below > self.miss:
                return m
        return SKETCH


def _word_table() -> np.ndarray:
    """Which code points are letters or digits."""
    global _WORD
    if _WORD is None:
        _WORD = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _WORD


def shingles(texts: list[str], words: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, key): the texts' runs of words as hashes, in order, bounds of each text's part, and a hash of
    its whole word sequence. Texts with fewer than least_words words have an empty part."""
    n_texts = len(texts)
    codes, off = code_points([t.lower() for t in texts])
    sizes, key = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.uint64)
    if not len(codes):
        return np.zeros(n_texts + 1, np.int64), np.empty(0, np.uint64), key
    alnum = _word_table()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[off[:-1]] = True  # words end with their text
    prev = np.concatenate([[False], alnum[:-1]])
    first = np.flatnonzero(alnum & (~prev | edge[:-1]))
    nxt = np.concatenate([alnum[1:], [False]])
    last = np.flatnonzero(alnum & (~nxt | edge[1:])) + 1
    pw, inv = _powers(len(codes))
    acc = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * pw[: len(codes)], out=acc[1:])
    word = mix((acc[last] - acc[first]) * inv[first] + (last - first).astype(np.uint64))
    text = np.searchsorted(off, first, "right") - 1
    count = np.bincount(text, minlength=n_texts)
    # the sequence of words, by place
    begin = np.concatenate([[0], np.cumsum(count)])
    place = (np.arange(len(word)) - begin[text]).astype(np.uint64)
    if len(word):
        np.add.at(key, text, mix(word ^ mix(place + np.uint64(77))))
    if len(word) < words:
        return np.zeros(n_texts + 1, np.int64), np.empty(0, np.uint64), key
    run = word[: len(word) - words + 1].copy()
    for i in range(1, words):
        run = mix(run) + word[i : len(word) - words + 1 + i]
    run = mix(run)
    ok = (text[: len(run)] == text[words - 1 :]) & (count[text[: len(run)]] >= max(words, least_words))
    run, text = run[ok], text[: len(run)][ok]
    sizes = np.bincount(text, minlength=n_texts)
    return np.concatenate([[0], np.cumsum(sizes)]), run, key


def _least(run: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    v = (run ^ mix(np.asarray([seed], np.uint64))[0]) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    return np.minimum.reduceat(v, starts)


def _signatures(j: Join):
    """(tbl, id, key, check, roots, sketch) of the records that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(2).to_pylist()
            for a, b in slices(texts):
                bounds, run, key = shingles(texts[a:b], j.words, j.least_words)
                has = np.flatnonzero(np.diff(bounds))
                if not len(has):
                    continue
                starts = bounds[:-1][has]
                roots = np.stack([mix(_least(run, starts, t + 1) + np.uint64(t)) for t in range(j.trees)], 1)
                sketch = np.stack([_least(run, starts, 1000 + s) & np.uint64(255) for s in range(SKETCH)], 1).astype(np.uint8)
                check = np.add.reduceat(mix(run ^ np.uint64(0x5BD1E995)), starts)
                take = pa.array(has + a)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * j.trees), pa.array(roots.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).take(take), rb.column(1).take(take), pa.array(key[has].view(np.int64)), pa.array(check.view(np.int64)), lists, pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["tbl", "id", "key", "check", "roots", "sketch"],
                )

    return run


def _agreeing(sk: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        out[k : k + (1 << 16)] = (sk[a[k : k + (1 << 16)]] == sk[b[k : k + (1 << 16)]]).sum(1) >= least
    return out


def join_nodes(node: np.ndarray, sk: np.ndarray, least: int, leaf: int, depth: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal nodes whose sketches agree enough; nodes beyond leaf branch along their chosen paths.

    A node that is still large after depth branchings holds records that are much alike; it is compared exhaustively,
    in blocks, as everything of it is likely to be wanted.
    """
    node, row = node.astype(np.uint64), np.arange(len(node))
    left, right = [], []
    for level in range(depth + 1):
        if not len(node):
            break
        o = np.argsort(node, kind="stable")
        node, row = node[o], row[o]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.repeat(np.diff(np.append(starts, len(node))), np.diff(np.append(starts, len(node))))
        big = size > leaf
        keep = (size > 1) & ~big
        n, r = node[keep], row[keep]
        for d in range(1, leaf):
            at = np.flatnonzero(n[d:] == n[:-d]) if len(n) > d else np.empty(0, np.int64)
            if not len(at):
                break
            a, b = r[at], r[at + d]
            ok = _agreeing(sk, a, b, least)
            left.append(a[ok])
            right.append(b[ok])
        node, row = node[big], row[big]
        if level == depth:
            for s, m in zip(*np.unique(node, return_index=True, return_counts=True)[1:], strict=True):
                g = row[s : s + m]
                for d in range(1, m):
                    ok = _agreeing(sk, g[d:], g[:-d], least)
                    left.append(g[d:][ok])
                    right.append(g[:-d][ok])
            break
        nodes, rows = [], []
        for branch in range(BRANCHES):
            c = (mix(node + np.uint64(branch * 7919 + 13)) % np.uint64(SKETCH)).astype(np.int64)
            nodes.append(mix(node ^ mix((c * 256 + sk[row, c]).astype(np.uint64) + np.uint64(1))))
            rows.append(row)
        node, row = np.concatenate(nodes) if nodes else node, np.concatenate(rows) if rows else row
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    return a, b


def _node_pairs(j: Join):
    """(tbl, a, b) from rows sorted by node; nodes hold crowd rows at most."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        node = t.column("node").to_numpy().view(np.uint64)
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        a, b = join_nodes(node, sk, j.agree, j.leaf)
        ids, tbl = t.column("id").to_numpy(), t.column("tbl").combine_chunks()
        lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        key = np.unique(np.stack([lo, hi, a], 1), axis=0) if len(a) else np.empty((0, 3), np.int64)
        if len(key):
            first = np.concatenate([[True], (key[1:, :2] != key[:-1, :2]).any(1)])
            key = key[first]
        return pa.RecordBatch.from_arrays([tbl.take(pa.array(key[:, 2])), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["tbl", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 60_000:
                continue
            key = held.column("node").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _candidates(reps: DataFrame, j: Join) -> DataFrame:
    """(tbl, a, b), a < b: pairs of representatives that met in a tree and agree in their sketches."""
    tree = F.posexplode("roots").alias("tree", "root")
    nodes = reps.select("tbl", "id", "sketch", tree).select(F.xxhash64("tbl", "tree", "root").alias("node"), "tbl", "id", "sketch")
    small, out = nodes, None
    for level in range(3):
        crowds = materialize(nodes.groupBy("node").count().where(F.col("count") > j.crowd).select("node"))
        any_crowd = crowds.limit(1).count() > 0
        small = nodes.join(crowds, "node", "left_anti") if any_crowd else nodes
        part = small.repartition("node").sortWithinPartitions("node").mapInArrow(_node_pairs(j), "tbl string, a long, b long")
        out = part if out is None else out.unionByName(part)
        if not any_crowd:
            return out.distinct()
        # branch across tasks along coordinates of the sketch, as within a task
        crowd = nodes.join(crowds, "node")
        c = F.pmod(F.xxhash64("node", "branch"), F.lit(SKETCH)).cast("int")
        nodes = crowd.withColumn("branch", F.explode(F.array(*map(F.lit, range(BRANCHES))))).withColumn("c", c)
        nodes = materialize(nodes.select(F.xxhash64("node", "c", F.substring("sketch", F.col("c") + 1, F.lit(1))).alias("node"), "tbl", "id", "sketch"))
    # what is still crowded is alike throughout: blocks of it, each against each
    crowds = materialize(nodes.groupBy("node").count().where(F.col("count") > j.crowd).select("node", F.ceil(F.col("count") / (j.crowd // 2)).cast("int").alias("blocks")))
    part = nodes.join(crowds.select("node"), "node", "left_anti").repartition("node").sortWithinPartitions("node").mapInArrow(_node_pairs(j), "tbl string, a long, b long")
    dealt = nodes.join(crowds, "node").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "tbl", "id", "sketch")
    rest = dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_node_pairs(j), "tbl string, a long, b long")
    return out.unionByName(part).unionByName(rest).distinct()


def _sets(j: Join):
    """(tbl, id, runs): the distinct word runs of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(2).to_pylist()
            for a, b in slices(texts):
                bounds, run, _ = shingles(texts[a:b], j.words, j.least_words)
                sets = [np.unique(run[x:y]).view(np.int64) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), rb.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], names=["tbl", "id", "runs"])

    return run


@dataclass(frozen=True)
class NearDuplicates:
    """members: (tbl, id, rep) of every record that takes part; pairs: (tbl, a, b, similarity) between representatives."""

    members: DataFrame
    pairs: DataFrame

    def expanded(self) -> DataFrame:
        """(tbl, id_a, id_b) of all pairs of records, copies among them; as many rows as there are pairs."""
        m = self.members
        same = self.copies()
        x = m.select("tbl", F.col("rep").alias("a"), F.col("id").alias("x"))
        y = m.select("tbl", F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.pairs.select("tbl", "a", "b").join(x, ["tbl", "a"]).join(y, ["tbl", "b"])
        return same.unionByName(across.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))

    def copies(self) -> DataFrame:
        """(tbl, id_a, id_b) of the pairs within classes of equal word sequences."""
        m = self.members
        several = m.groupBy("tbl", "rep").count().where("count > 1").select("tbl", "rep")
        some = m.join(several, ["tbl", "rep"])
        return some.select("tbl", "rep", F.col("id").alias("id_a")).join(some.select("tbl", "rep", F.col("id").alias("id_b")), ["tbl", "rep"]).where("id_a < id_b").select("tbl", "id_a", "id_b")

    def groups(self) -> DataFrame:
        """(tbl, id, group_id, links): the connected group of every record with a partner, and how many classes it is linked to."""
        linked = self.pairs.select("tbl", F.explode(F.array("a", "b")).alias("rep")).groupBy("tbl", "rep").agg(F.count("*").alias("links"))
        node = {x: F.struct("tbl", F.col(x).alias("id")) for x in "ab"}
        edges = self.pairs.select(F.explode(F.array(node["a"], node["b"])).alias("id"), F.struct("tbl", "a", "b").alias("key"))
        out = components(edges).select("id.tbl", F.col("id.id").alias("rep"), F.col("group_id.id").alias("group_id"))
        several = self.members.groupBy("tbl", "rep").count().where("count > 1").select("tbl", "rep")
        wanted = several.select("tbl", "rep").unionByName(linked.select("tbl", "rep")).distinct().join(out, ["tbl", "rep"], "left").join(linked, ["tbl", "rep"], "left")
        return self.members.join(wanted, ["tbl", "rep"]).select("tbl", "id", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, j: Join = Join()) -> NearDuplicates:
    """Similar records of docs (tbl string, id long, text string); records of different tbl are never compared.

    Words are the lower-cased runs of letters and digits. Rows with a null tbl, id or text and texts under least_words
    words take no part; repeated ids are records of equal id, compared as one if their texts are equal; empty tables
    give empty results; other columns are left behind. Records with the same word sequence form a class first (so a
    group of copies of any size is one record to the join); the smallest id stands for it.
    """
    docs = docs.select("tbl", F.col("id").cast("long").alias("id"), "text").where("tbl IS NOT NULL AND id IS NOT NULL AND text <> ''")
    sig = materialize(docs.mapInArrow(_signatures(j), "tbl string, id long, key long, check long, roots array<long>, sketch binary"))
    classes = sig.groupBy("tbl", "key", "check").agg(F.min("id").alias("rep"), F.any_value("roots").alias("roots"), F.any_value("sketch").alias("sketch"))
    members = sig.select("tbl", "key", "check", "id").distinct().join(classes.select("tbl", "key", "check", "rep"), ["tbl", "key", "check"]).select("tbl", "id", "rep")
    found = materialize(_candidates(classes.select("tbl", F.col("rep").alias("id"), "roots", "sketch"), j).where("a <> b"))
    wanted = found.select("tbl", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(docs.join(wanted, ["tbl", "id"], "left_semi").select("tbl", "id", "text").mapInArrow(_sets(j), "tbl string, id long, runs array<long>").where(F.size("runs") > 0).dropDuplicates(["tbl", "id"]))
    s = found.join(sets.select("tbl", F.col("id").alias("a"), F.col("runs").alias("ra")), ["tbl", "a"]).join(sets.select("tbl", F.col("id").alias("b"), F.col("runs").alias("rb")), ["tbl", "b"])
    both = F.size(F.array_intersect("ra", "rb"))
    pairs = s.select("tbl", "a", "b", both.alias("n"), (F.size("ra") + F.size("rb")).alias("m")).select("tbl", "a", "b", (F.col("n") / (F.col("m") - F.col("n"))).alias("similarity"))
    return NearDuplicates(members, pairs.where(F.col("similarity") >= j.threshold))
