"""From two ranked lists to the passages of an answer: fusion, caps, topping up, widening, hydration, packing.

All are windows over batches of questions; every ranked list counts from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import approx_tokens
from tesserae.operators.lexical import Backend, Lexical, search
from tesserae.operators.vectors import first_k, topk
from tesserae.session import materialize


def _order(by: str, *more: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*more)) - 1


def fuse(lexical: DataFrame, ann: DataFrame, k: int, cap: int) -> DataFrame:
    """(qid, chunk_id, pos): the two lists taken in turns, lexical first, each passage once, cap lexical ones, k in all.

    lexical: qid, chunk_id, lex_rank. ann: qid, chunk_id, ann_rank. A passage's turn is the earlier of its two.
    """
    turns = lexical.where(F.col("lex_rank") < cap).select("qid", "chunk_id", (2 * F.col("lex_rank")).alias("turn"))
    turns = turns.unionByName(ann.select("qid", "chunk_id", (2 * F.col("ann_rank") + 1).alias("turn")))
    once = turns.groupBy("qid", "chunk_id").agg(F.min("turn").alias("turn"))
    return first_k(once, k, "pos", "qid", "turn").select("qid", "chunk_id", "pos")


def cap_per_paper(ranked: DataFrame, cap: int) -> DataFrame:
    """Rows (qid, chunk_id, paper_id, pos) that are among the first cap of their paper; cap 0 or less keeps all."""
    if cap <= 0:
        return ranked
    w = Window.partitionBy("qid", "paper_id").orderBy("pos")
    return ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def capped_and_filled(segments: DataFrame, k: int, cap: int) -> DataFrame:
    """(qid, chunk_id, paper_id, pos): segments read one after another, each passage once, cap of a paper, k in all.

    segments: qid, chunk_id, paper_id, segment, rank. Segment 0 is the fused list (k at most), the others fill it up.
    """
    first = segments.groupBy("qid", "chunk_id").agg(F.min(F.struct("segment", "rank", "paper_id")).alias("m")).select("qid", "chunk_id", "m.segment", "m.rank", "m.paper_id")
    w = Window.partitionBy("qid", "paper_id").orderBy("segment", "rank")
    kept = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return first_k(kept, k, "pos", "qid", "segment", "rank").select("qid", "chunk_id", "paper_id", "pos")


def average_chunks(shortlist: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, avg_chunks): passages of the shortlisted papers by the number of shortlist rows; papers without any count."""
    n = chunks.join(shortlist.select("paper_id").distinct(), "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n"))
    of = shortlist.groupBy("qid").agg(F.count("*").alias("rows"))
    sums = shortlist.select("qid", "paper_id").distinct().join(n, "paper_id", "left").groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return of.join(sums, "qid").select("qid", F.round(F.col("n") / F.col("rows"), 6).alias("avg_chunks"))


def scopes(questions: DataFrame, shortlist: DataFrame, chunks: DataFrame, threshold: float = 2.0, force_global: bool = False) -> DataFrame:
    """(qid, ann_scope, lexical_scope): 'candidates', 'global' or 'none' for each question.

    A shortlist whose papers have fewer passages on average than threshold is given up: both scopes are global then.
    Without a shortlist the vectors are searched globally and terms only if force_global says so.
    """
    avg = average_chunks(shortlist, chunks)
    s = questions.select("qid").join(avg, "qid", "left")
    sparse = F.col("avg_chunks").isNotNull() & (F.col("avg_chunks") < threshold)
    ann = F.when(F.col("avg_chunks").isNull() | sparse, "global").otherwise("candidates")
    lex = F.when(sparse | F.lit(force_global), "global").when(F.col("avg_chunks").isNull(), "none").otherwise("candidates")
    return s.select("qid", ann.alias("ann_scope"), lex.alias("lexical_scope"))


def shortlist_papers(query_vectors: DataFrame, paper_vectors: DataFrame, k: int, width: int) -> DataFrame:
    """(qid, paper_id, score, rank): the papers nearest to each question. Both have id, v."""
    return topk(query_vectors, paper_vectors, k, width).withColumnRenamed("id", "paper_id")


def search_passages(
    questions: DataFrame,
    query_vectors: DataFrame,
    shortlist: DataFrame,
    chunks: DataFrame,
    papers: DataFrame,
    vectors: DataFrame,
    k: int,
    width: int,
    overshoot: int = 20,
    threshold: float = 2.0,
    cap: int = 0,
    lexical: Lexical = Lexical(),
    force_global: bool = False,
    widen: str = "candidates",
    backend: Backend | None = None,
    find: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """(qid, chunk_id, paper_id, pos): the passages for each question.

    questions: qid, terms. query_vectors and vectors: id, v. shortlist: qid, paper_id. The vectors are searched once, as
    widely as the second widening would; its narrower steps are ranges of that list. widen: whether widened passages
    must be of shortlisted papers ('candidates') or may be of any ('global'). find(query_vectors, k) answers from an
    index; without it all vectors are searched. A question whose vector search finds
    nothing has no passages at all, lexical ones included.
    """
    wide = max(k * overshoot, 100)
    steps = [wide, min(2 * wide, 10_000), min(4 * wide, 10_000)] if cap > 0 else [wide]
    keys = chunks.select("chunk_id", "paper_id")
    shortlist = materialize(shortlist.select("qid", "paper_id"))
    scope = materialize(scopes(questions, shortlist, chunks, threshold, force_global))
    nearest = find(query_vectors, steps[-1]) if find else topk(query_vectors, vectors, steps[-1], width)
    found = nearest.select("qid", F.col("id").alias("chunk_id"), "rank").join(keys, "chunk_id")
    cand = shortlist.select("qid", "paper_id").distinct().withColumn("listed", F.lit(True))
    found = found.join(scope, "qid").join(cand, ["qid", "paper_id"], "left")
    found = found.withColumn("fits", (F.col("ann_scope") == "global") | F.col("listed").isNotNull()).select("qid", "chunk_id", "paper_id", "rank", "fits")
    found = materialize(found)  # a bounded list for each question, read several times
    near = found.where((F.col("rank") < wide) & F.col("fits"))
    ann = near.withColumn("ann_rank", _order("qid", "rank"))
    some = found.select("qid").distinct()
    lex = search(questions.join(some, "qid", "left_semi"), chunks, papers, lexical, shortlist, backend, scope)
    fused = fuse(lex, ann, k, lexical.cap_for(k)).join(keys, "chunk_id").select("qid", "chunk_id", "paper_id", "pos")
    if cap <= 0:
        return fused
    segs = fused.select("qid", "chunk_id", "paper_id", F.lit(0).alias("segment"), F.col("pos").alias("rank"))
    segs = segs.unionByName(ann.select("qid", "chunk_id", "paper_id", F.lit(1).alias("segment"), F.col("ann_rank").alias("rank")))
    for n, (lo, hi) in enumerate(zip(steps[:-1], steps[1:], strict=True), 2):
        more = found.where((F.col("rank") >= lo) & (F.col("rank") < hi))
        if widen == "candidates":
            more = more.where("fits")
        segs = segs.unionByName(more.select("qid", "chunk_id", "paper_id", F.lit(n).alias("segment"), "rank"))
    return capped_and_filled(segs, k, cap)


def hydrate(ranked: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, pos, chunk_id, paper_id, ord, text, paper_title, pmid, pmcid) of ranked rows (qid, chunk_id, pos); nulls become ''."""
    r = ranked.select("qid", "chunk_id", "pos").join(chunks.select("chunk_id", "paper_id", "ord", "text"), "chunk_id")
    r = r.join(papers.select("paper_id", F.col("title").alias("paper_title"), "pmid", "pmcid"), "paper_id")
    return r.select("qid", "pos", "chunk_id", "paper_id", "ord", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "paper_title", "pmid", "pmcid")])


def block(i: Column, title: Column, pmcid: Column, pmid: Column, text: Column) -> Column:
    """[i] title (PMCID:x), or (PMID:x) where there is no pmcid, and the text on the next line."""
    tail = F.when(pmcid != "", F.concat(F.lit(" (PMCID:"), pmcid, F.lit(")"))).when(pmid != "", F.concat(F.lit(" (PMID:"), pmid, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.trim(title), tail, F.lit("\n"), text)


def token_room(question: Column, prompt: str, budget: int, max_out: Column | int, headroom: int = 200) -> Column:
    """Tokens left for context: the budget less the answer, the prompt, the question and the headings."""
    out = max_out if isinstance(max_out, Column) else F.lit(max_out)
    out = F.when(out >= budget, max(128, budget // 4)).otherwise(out)
    fixed = sum(max(1, len(s) // 4) for s in (prompt, "QUESTION:\n", "\n\nCONTEXT:\n")) + headroom
    return F.greatest(F.lit(0), F.greatest(F.lit(0), F.lit(budget) - out) - fixed - approx_tokens(question))


def costed(passages: DataFrame) -> DataFrame:
    """(qid, idx, chunk_id, block, cost, used): blocks of the passages (as of hydrate) and what they cost one after another."""
    b = passages.withColumn("idx", (F.col("pos") + 1).cast("int"))
    b = b.withColumn("block", block(F.col("idx"), F.col("paper_title"), F.col("pmcid"), F.col("pmid"), F.col("text"))).withColumn("cost", approx_tokens("block") + 20)
    used = F.sum("cost").over(Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("qid", "idx", "chunk_id", "block", "cost", used.alias("used"))


def pack_context(passages: DataFrame, questions: DataFrame, prompt: str, budget: int, max_out: int, headroom: int = 200) -> DataFrame:
    """(qid, idx, chunk_id, block, cost, used): the passages, in order, that fit the budget; the first that does not ends the list.

    passages: as of hydrate. questions: qid, question. Costs are positive, so a running sum says what fits.
    """
    b = costed(passages).join(questions.select("qid", token_room(F.col("question"), prompt, budget, max_out, headroom).alias("room")), "qid")
    return b.where("used <= room").drop("room")


def attempts(passages: DataFrame, questions: DataFrame, prompt: str, budget: int, max_out: int, headroom: int = 200, times: int = 4) -> DataFrame:
    """(qid, question, attempts array<struct<blocks, max_out>>): what each call for a question's answer sends.

    The first sends what pack_context gives; each further one, for the case that the model finds the last too long,
    fewer of the passages and asks for less, as retry_schedule says. Lists are as long as one budget holds.
    """
    b = costed(passages)
    n = b.groupBy("qid").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "used", "block"))).alias("b"))
    q = questions.select("qid", "question").join(n, "qid", "left").withColumn("plan", retry_schedule(F.coalesce("n", F.lit(0)), F.lit(max_out), times))

    def sent(s: Column) -> Column:
        room = token_room(F.col("question"), prompt, budget, s["max_out"], headroom)
        fit = F.filter(F.coalesce("b", F.array()), lambda x: (x["idx"] <= s["chunks"]) & (x["used"] <= room))
        return F.struct(F.transform(fit, lambda x: x["block"]).alias("blocks"), s["max_out"].alias("max_out"))

    return q.select("qid", "question", F.transform("plan", sent).alias("attempts"))


def contexts(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, context, n_used): blocks put together, or '(no context)'."""
    c = packed.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("idx", "block"))).alias("b"))
    text = F.when(F.col("b").isNull(), "(no context)").otherwise(F.array_join(F.col("b.block"), "\n\n"))
    return questions.select("qid").join(c, "qid", "left").select("qid", text.alias("context"), F.coalesce(F.size("b"), F.lit(0)).alias("n_used"))


def retry_schedule(chunks: Column, max_out: Column, attempts: int = 4) -> Column:
    """array<struct<attempt, chunks, max_out>>: what each attempt after an overflow sends: 7 of 10 passages, then half;
    three quarters of the answer's tokens, 128 at least."""
    state = "struct<chunks:int,max_out:int,out:array<struct<attempt:int,chunks:int,max_out:int>>>"

    def step(s: Column, i: Column) -> Column:
        fewer = F.when(i == 0, F.floor(s["chunks"].cast("double") * F.lit(0.7))).otherwise(F.floor(s["chunks"] / 2))
        nxt = F.when(s["chunks"] > 1, F.greatest(F.lit(1), fewer)).otherwise(s["chunks"])
        rec = F.struct(i.alias("attempt"), s["chunks"].alias("chunks"), s["max_out"].alias("max_out"))
        return F.struct(nxt.cast("int").alias("chunks"), F.greatest(F.lit(128), F.floor(s["max_out"] * 3 / 4)).cast("int").alias("max_out"), F.concat(s["out"], F.array(rec)).alias("out")).cast(state)

    first = F.struct(chunks.cast("int").alias("chunks"), max_out.cast("int").alias("max_out"), F.array().alias("out")).cast(state)
    return F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), first, step, lambda s: s["out"])
