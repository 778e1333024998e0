"""Exact matching of question terms inside passages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import search_form
from tesserae.operators.vectors import first_k
from tesserae.session import materialize


@dataclass(frozen=True)
class Lexical:
    """limit: passages a question; min_length and max_terms: see rare_terms; cap: of them in the fused list."""

    limit: int = 200
    min_length: int = 9
    max_terms: int = 8
    cap: int | None = None
    enabled: bool = True

    def cap_for(self, k: int) -> int:
        return self.cap if self.cap is not None else max(5, k // 3)


class Backend(Protocol):
    """Finds which of the terms stand in which text, both in search form: the columns of texts but text, and term."""

    def hits(self, texts: DataFrame, terms: DataFrame) -> DataFrame: ...


class Contains:
    """A join on containment: for a handful of terms, since each text is searched for each term."""

    def hits(self, texts: DataFrame, terms: DataFrame) -> DataFrame:
        t = texts.withColumn("text", search_form("text"))
        return t.join(terms.select("term").where("term <> ''").distinct(), F.col("text").contains(F.col("term"))).drop("text")


class Automaton:
    """One pass over each text for all terms, with an Aho-Corasick automaton where that library is there.

    Up to most characters of terms go with the tasks, and each text is looked at where it lies. More terms than that
    are met in blocks, each text with each block, so their number is not bounded.
    """

    def __init__(self, block: int = 20_000, most: int = 8_000_000):
        self.block, self.most = block, most

    def hits(self, texts: DataFrame, terms: DataFrame) -> DataFrame:
        distinct = materialize(terms.select("term").where("term <> ''").distinct())
        size = distinct.agg(F.coalesce(F.sum(F.length("term") + 8), F.lit(0))).first()[0]
        keep = [c for c in texts.columns if c != "text"]
        t = texts.select(*keep, search_form("text").alias("norm")).where("norm IS NOT NULL")
        schema = texts.select(*keep).schema.add("term", T.StringType())
        if size <= self.most:
            sent = texts.sparkSession.sparkContext.broadcast(sorted(r.term for r in distinct.collect()))
            return t.mapInArrow(_look(sent, keep), schema)
        packed = distinct.coalesce(1).mapInArrow(_packer(self.block), "number int, terms array<string>")
        # a stated set of questions, in blocks, against all texts, also in blocks
        kinds = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in t.schema.fields)
        return t.mapInArrow(_bundle, kinds).crossJoin(packed).mapInArrow(_scan(keep), schema)


_FINDERS: dict[str, object] = {}


def _look(sent, keep: list[str]):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _FINDERS:
            # one set of terms at a time: the automaton of the last questions stays for the worker's next task
            _FINDERS.clear()
            _FINDERS[name] = _finder(sent.value)
        find = _FINDERS[name]
        for rb in batches:
            row, out = [], []
            for i, text in enumerate(rb.column(rb.num_columns - 1).to_pylist()):
                found = find(text)
                row += [i] * len(found)
                out += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rb.columns[:-1]), pa.array(out, pa.string())], names=[*keep, "term"])

    return run


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            rb = whole.slice(k, 256)
            lists = [pa.ListArray.from_arrays(pa.array([0, rb.num_rows], pa.int32()), pa.concat_arrays([c])) for c in rb.columns]
            yield pa.RecordBatch.from_arrays(lists, names=rb.schema.names)


def _packer(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        number = 0

        def out(part: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part], pa.list_(pa.string()))], names=["number", "terms"])

        for rb in batches:
            held += rb.column(0).to_pylist()
            while len(held) >= block:
                yield out(held[:block])
                held, number = held[block:], number + 1
        if held:
            yield out(held)

    return run


def _finder(terms: list[str]):
    try:
        import ahocorasick
    except ImportError:
        return _by_words(terms)
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return (lambda text: {t for _, t in a.iter(text)}) if terms else (lambda text: set())


def _by_words(terms: list[str]):
    """Without the library: terms by their first three characters, tried only where these stand."""
    short, starts = [t for t in terms if len(t) < 3], {}
    for t in terms:
        if len(t) >= 3:
            starts.setdefault(t[:3], []).append(t)

    def find(text: str) -> set[str]:
        there = {text[i : i + 3] for i in range(len(text) - 2)}
        return {t for t in short if t in text} | {t for s in there & starts.keys() for t in starts[s] if t in text}

    return find


def _scan(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[int, object] = {}
        for rb in batches:
            for i, number in enumerate(rb.column(rb.num_columns - 2).to_pylist()):
                if number not in finders:
                    finders[number] = _finder(rb.column(rb.num_columns - 1)[i].as_py())
                row, out = [], []
                for j, text in enumerate(rb.column(len(keep))[i].as_py()):
                    found = finders[number](text)
                    row += [j] * len(found)
                    out += found
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(rb.column(c)[i].values.take(at) for c in range(len(keep))), pa.array(out, pa.string())], names=[*keep, "term"])

    return run


def search(questions: DataFrame, chunks: DataFrame, papers: DataFrame, config: Lexical = Lexical(), candidates: DataFrame | None = None, backend: Backend | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, paper_id, lex_rank): passages that hold any term of their question, ranked from 0.

    questions: qid, terms (array). Passages without a paper row do not count. Title-and-abstract passages come first,
    then those whose paper's title holds the first term, then papers with a pmid, with a pmcid, then by chunk_id; limit
    of them. candidates (qid, paper_id) restrict each question to its papers, or, with scope (qid, lexical_scope), those
    questions whose scope is 'candidates'; a question without a scope, or with another than 'global', has no passages.
    """
    terms = questions.select("qid", F.posexplode("terms").alias("n", "raw")).select("qid", "n", search_form("raw").alias("term"))
    if not config.enabled:
        terms = terms.limit(0)
    hits = (backend or Automaton()).hits(chunks.select("chunk_id", "paper_id", "ord", "text"), terms)
    rows = hits.join(terms.select("qid", "term").distinct(), "term").select("qid", "chunk_id", "paper_id", "ord").distinct()
    if scope is not None:
        listed = candidates.select("qid", "paper_id").distinct().withColumn("listed", F.lit(True))
        rows = rows.join(scope.select("qid", "lexical_scope"), "qid").join(listed, ["qid", "paper_id"], "left")
        rows = rows.where((F.col("lexical_scope") == "global") | ((F.col("lexical_scope") == "candidates") & F.col("listed").isNotNull())).drop("lexical_scope", "listed")
    elif candidates is not None:
        rows = rows.join(candidates.select("qid", "paper_id").distinct(), ["qid", "paper_id"], "left_semi")
    rows = rows.join(papers.select("paper_id", "title", "pmid", "pmcid"), "paper_id")
    rows = rows.join(terms.where("n = 0").select("qid", F.col("term").alias("hint")), "qid", "left")
    order = [
        F.desc(F.col("ord") == -1),
        F.desc(F.coalesce(search_form("title").contains(F.col("hint")), F.lit(False))),
        F.desc(F.col("pmid").isNotNull()),
        F.desc(F.col("pmcid").isNotNull()),
        F.asc("chunk_id"),
    ]
    return first_k(rows, config.limit, "lex_rank", "qid", *order).select("qid", "chunk_id", "paper_id", "lex_rank")
