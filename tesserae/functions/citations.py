"""Numbered citations in answers: one form, expansion, renumbering by document, and the list of references."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What opens and closes a citation, parts its entries and joins the ends of a range, and what is not seen.
CLOSED_BY = {"[": "]", "【": "】"}
SEPARATORS = ",，、;；"
DASHES = "-–—"
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff"
#: Separators that count when citations are renumbered; a list with others has not been brought to one form.
STRICT = ",，、"


class Entry(NamedTuple):
    """One number or range of a citation: its plain spelling, and its ends as digits without leading zeros."""

    spelling: str
    low: str
    high: str


class Bracket(NamedTuple):
    begin: int
    end: int
    body: str


def brackets(text: str) -> Iterator[Bracket]:
    """Innermost pairs of brackets of one kind, in order; begin and end enclose both brackets."""
    begin, closing = -1, ""
    for i, ch in enumerate(text):
        if ch in CLOSED_BY:
            begin, closing = i, CLOSED_BY[ch]
        elif begin >= 0 and ch in CLOSED_BY.values():
            if ch == closing:
                yield Bracket(begin, i + 1, text[begin + 1 : i])
            begin = -1


def _digits(s: str) -> str | None:
    """A whole number as plain digits; None for anything else."""
    s = s.strip()
    return ("".join(str(unicodedata.decimal(c)) for c in s).lstrip("0") or "0") if s.isdecimal() else None


def entries(body: str, separators: str = SEPARATORS) -> list[Entry | None]:
    """The entries of a bracket's body in order, None for what is neither a number nor a range."""
    for c in separators[1:]:
        body = body.replace(c, separators[0])
    out: list[Entry | None] = []
    for piece in body.split(separators[0]):
        dash = next((c for c in piece if c in DASHES), "")
        low, _, high = piece.partition(dash) if dash else (piece, "", piece)
        low, high = _digits(low), _digits(high)
        if low is None or high is None:
            out.append(None)
        else:
            out.append(Entry(f"{low}{dash}{high}" if dash else low, low, high))
    return out


def _placed(body: str) -> tuple[str, bool]:
    """body without a mark of lines (†L3-L6) at its end, and the same without a mark of a source (2:0†name)."""
    head, mark, tail = body.rpartition("†")
    if mark and head.rstrip()[-1:].isdecimal():
        ends = tail.strip().lstrip("L") if tail.startswith("L") else ""
        for c in DASHES:
            ends = ends.replace(c, "-")
        first, _, last = ends.partition("-")
        if _digits(first) and (not last or _digits(last.removeprefix("L"))):
            return head.rstrip(), True
    return body, False


def _unsourced(body: str) -> str:
    head, mark, name = body.rstrip().partition("†")
    numbers, colon, place = head.rpartition(":")
    return numbers if mark and colon and _digits(place) and name and not any(map(str.isspace, name)) else body


def one_form(text: str | None) -> str | None:
    """Citations like [1, 2-4]: square brackets, no line locations, comma and space, each entry once, no leading zeros.

    A bracket that holds anything but a list of numbers and ranges is prose and stays.
    """
    if text is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKC", text) if c not in UNSEEN)
    s = s.replace("【", "[").replace("】", "]")
    out, at = [], 0
    for b in brackets(s):
        body, lined = _placed(b.body)
        got = entries(_unsourced(body))
        if None not in got:
            body = ", ".join(dict.fromkeys(e.spelling for e in got))
        elif not lined:
            continue
        out += [s[at : b.begin], "[", body, "]"]
        at = b.end
    return "".join(out) + s[at:]


@F.pandas_udf(T.StringType())
def citations_in_one_form(s: pd.Series) -> pd.Series:
    return s.map(one_form)


def _lists(text: str) -> Iterator[tuple[Bracket, list[Entry]]]:
    """Brackets of nothing but digits, commas, dashes and space, with what in them is a number or a range."""
    for b in brackets(text):
        if b.body and all(c in "0123456789" or c in STRICT or c in DASHES or c.isspace() for c in b.body):
            yield b, [e for e in entries(b.body, STRICT) if e]


def numbers(got: list[Entry], n: int) -> list[int]:
    """What the entries say, in order: a range from its smaller end and within 1 to n, single numbers as they are.

    The ends of a range may have any number of digits; single numbers of more than nine are left out.
    """

    def held(digits: str) -> int:
        return int(digits) if len(digits) <= len(str(n)) else n + 1

    out: list[int] = []
    for e in got:
        if e.spelling == e.low:
            out += [int(e.low)] if len(e.low) < 10 else []
        else:
            lo, hi = sorted((held(e.low), held(e.high)))
            out += range(max(1, lo), min(hi, n) + 1)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def cited(text: pd.Series, n: pd.Series) -> pd.Series:
    """All numbers that a text cites, in order, ranges within 1 to n."""
    return pd.Series([None if t is None or m is None or pd.isna(m) else [x for _, got in _lists(t) for x in numbers(got, int(m))] for t, m in zip(text, n, strict=True)])


def document_key(doi: Column, pmcid: Column, pmid: Column, paper_id: Column, title: Column, row: Column) -> Column:
    """What makes passages one document: the first of doi, pmcid, pmid, paper id, title that is there; else the row itself."""

    def some(tag: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(tag), c))

    return F.coalesce(
        some("doi:", F.lower(F.trim(doi))),
        some("pmcid:", F.upper(F.trim(pmcid))),
        some("pmid:", F.trim(pmid)),
        F.when(paper_id.isNotNull(), F.concat(F.lit("paper:"), paper_id.cast("string"))),
        some("title:", F.lower(F.trim(title))),
        F.concat(F.lit("row:"), row.cast("string")),
    )


def mentions(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, key, docnum, first): documents of each answer, numbered by their first mention.

    answers: qid, answer. passages: qid, idx (1-based, as cited), key. Numbers without a passage are no mentions.
    """
    count = passages.groupBy("qid").agg(F.max("idx").alias("n"))
    said = answers.join(count, "qid").select("qid", F.posexplode(cited("answer", "n")).alias("pos", "idx"))
    first = said.join(passages.select("qid", "idx", "key"), ["qid", "idx"]).groupBy("qid", "key").agg(F.min("pos").alias("first"))
    return first.withColumn("docnum", F.row_number().over(Window.partitionBy("qid").orderBy("first")))


def renumbered(answer: str | None, docnum_of: dict[int, int]) -> str | None:
    """The answer with the passage numbers of each list replaced by those of their documents, each once.

    A list of which no number has a document stays as it is.
    """
    if answer is None:
        return None
    last, out, at = max(docnum_of, default=0), [], 0
    for b, got in _lists(answer):
        docs = {docnum_of[i]: None for i in numbers(got, last) if i in docnum_of}
        if docs:
            out += [answer[at : b.begin], f"[{', '.join(map(str, docs))}]"]
            at = b.end
    return "".join(out) + answer[at:]


@F.pandas_udf(T.StringType())
def _renumber(answer: pd.Series, idx: pd.Series, docnum: pd.Series) -> pd.Series:
    return pd.Series([renumbered(a, dict(zip(i if i is not None else (), d if d is not None else (), strict=True))) for a, i, d in zip(answer, idx, docnum, strict=True)])


def renumber(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, answer): answers that cite documents instead of passages."""
    docs = mentions(answers, passages)
    of = passages.select("qid", "idx", "key").join(docs, ["qid", "key"]).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("idx", "docnum"))).alias("m"))
    return answers.join(of, "qid", "left").select("qid", F.when(F.col("m").isNull(), F.col("answer")).otherwise(_renumber("answer", F.col("m.idx"), F.col("m.docnum"))).alias("answer"))


def reference_line(docnum: Column, title: Column, year: Column, doi: Column, pmcid: Column, pmid: Column, single_stop: bool = False) -> Column:
    """[n] Title (year).. DOI: x, PMCID: y, PMID: z. The full stop before the identifiers is doubled unless single_stop."""

    def some(tag: str, c: Column) -> Column:
        return F.when(F.trim(c) != "", F.concat(F.lit(tag), F.trim(c)))

    ids = F.concat_ws(", ", some("DOI: ", doi), some("PMCID: ", pmcid), some("PMID: ", pmid))
    name = F.coalesce(F.when(F.trim(title) != "", F.trim(title)), F.lit("untitled"))
    stop = "" if single_stop else "."
    return F.concat(F.lit("["), docnum.cast("string"), F.lit("] "), name, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")), F.lit("."), F.when(ids != "", F.concat(F.lit(f"{stop} "), ids)).otherwise(""))


def references(docs: DataFrame, single_stop: bool = False) -> DataFrame:
    """(qid, block): the header and a line for each document, by number. docs: qid, docnum, title, year, doi, pmcid, pmid."""
    c = F.col
    line = reference_line(c("docnum"), c("title"), c("year"), c("doi"), c("pmcid"), c("pmid"), single_stop)
    per = docs.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("docnum", line.alias("line")))).alias("l"))
    return per.select("qid", F.concat(F.lit("References\n"), F.array_join(F.col("l.line"), "\n")).alias("block"))
