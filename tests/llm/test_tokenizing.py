import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.tokenizing import ChunkEncoder, count_tokens, encode_texts, load

WORDS = ["the", " cell", "  ", "\n", "naïve", "don't", "'s", "论文", "<|endoftext|>", "\x00", "\U0001f600", "a" * 40, " 12", ",", "\x1c x", " b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=5)), max_size=120).map("".join), st.sampled_from([2, 8, 64]))
def test_equals_whole_text(text, chunk):
    assert list(ChunkEncoder(mean_chunk=chunk).batch([text, text]))[1] == load().encode_ordinary(text)


def test_chunks_are_reused():
    rng = random.Random(3)
    body = " ".join(rng.choice(["cell", "tissue", "of", "mice", "grew"]) + str(rng.randrange(999)) for _ in range(3000))
    enc = ChunkEncoder()
    list(enc.batch([body]))
    before = enc.misses
    texts = ["Other start. " + body, body[700:]]
    assert list(enc.batch(texts)) == [load().encode_ordinary(t) for t in texts]
    assert enc.misses - before < 12


def test_small_store():
    texts = [f"word{i} and more words follow here " * 30 for i in range(50)]
    assert list(ChunkEncoder(kept_chars=100).batch(texts)) == [load().encode_ordinary(t) for t in texts]


def test_frame(spark):
    long = "Serial cells grew in vivo; " * 20000
    rows = [(1, "hello world", 1), (2, "", 2), (3, None, 3), (1, "hello world", 1), (4, "<|endoftext|>", 4), (5, long, 5), (6, " ", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in encode_texts(df, "text").collect()]
    e = load()
    assert sorted(got) == sorted((i, e.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert {r.doc_id: list(r.ids) for r in encode_texts(df, "text", empty_ids=(7,), null_ids=(9,)).collect()}[3] == [9]
    assert sum(r.n_tokens for r in count_tokens(df, "text").collect()) == sum(len(x) for _, x in got)
    assert encode_texts(df.limit(0), "text").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=5)), min_size=1, max_size=60).map("".join), st.lists(st.integers(1, 200), max_size=6))
def test_joins_are_repaired_wherever_a_text_is_cut(text, cuts):
    ends = [*sorted({c for c in cuts if c < len(text)}), len(text)]
    if text:
        assert ChunkEncoder()._joined(text, ends) == load().encode_ordinary(text)


def test_repairs_happen():
    enc = ChunkEncoder()
    assert enc._joined("hello world", [3, 8, 11]) == load().encode_ordinary("hello world") and enc.repaired == 2
