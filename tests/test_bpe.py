"""Byte-pair counts against the library, and chunk plans by running sums against counts of strings."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.functions import bpe
from corpusq.functions.bpe import BytePairs, PieceLayout, Ranks, parse_ranks
from corpusq.functions.chunk import chunks_of, measured, sizes_of
from corpusq.functions.score import STAGED
from corpusq.plans import pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = parse_ranks(f.read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = Ranks(RANKS)
PIECES = ["don't", "'tis", "  ", "\n", " ", "\n\n", "The", "hello", "It's", "x", "1234", "é", "日本語", "...", "!!", "\t", "a" * 90, "ab" * 60, " " * 100, "'s", "'ll", "-", "tokenization", "<|endoftext|>", "\x85", "　"]
SENTENCES = ["Hello there, it's me.", "The 'tis thing! ", " 'tis said? ", "A  b   c.\n", "Don't stop.", "\n\n'Twas brillig. ", "Über alles ", "x" * 30 + " ", "I ", "日本。A "]


class Plain:
    def __call__(self, text):
        return OWN.count(text)


class WithLayout(Plain):
    def layout(self, text):
        return PieceLayout(text, OWN)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.text(max_size=40)))
def test_counts_equal_the_library(text):
    assert OWN.count(text) == len(LIBRARY.encode_ordinary(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SENTENCES), max_size=30).map("".join), st.sampled_from([3, 8, 20, 50]), st.sampled_from([0, 1, 2]))
def test_chunks_by_sums_equal_chunks_by_strings(text, limit, overlap):
    want = chunks_of(text, limit, overlap, Plain())
    assert chunks_of(text, limit, overlap, WithLayout()) == want
    assert sizes_of(text, limit, overlap, WithLayout()) == [n for _, n, _ in want]


def test_long_and_short_merges_agree():
    rng = random.Random(1)
    for _ in range(200):
        piece = "".join(rng.choice("abcdehilnorst") for _ in range(rng.randrange(2, 200))).encode()
        assert OWN._merged_short(piece) == OWN._merged_long(piece)
    assert OWN.count("qwertzuiop" * 20_000) == len(LIBRARY.encode_ordinary("qwertzuiop" * 20_000))
    assert OWN.count("") == 0


def test_counter_in_a_table(spark):
    counter = BytePairs.load(spark, f"file://{PATH}")
    rows = [(1, "Hello there, it's me. " * 200), (2, "The end."), (3, None), (4, ""), (5, "x" * 5000 + " " + "It said so. " * 40)]
    df = spark.createDataFrame(rows, "i int, text string")
    tokens = pipeline.Tokens.of(counter)
    got = {r.i: r.n for r in df.select("i", tokens.column(F.col("text")).alias("n")).collect()}
    assert got == {i: None if t is None else len(LIBRARY.encode_ordinary(t)) for i, t in rows}
    raw = df.selectExpr("cast(i as string) AS review_id", "'u' AS user_id", "'b' AS business_id", "1D AS stars", "0L AS useful", "0L AS funny", "0L AS cool", "text", "'2020-01-01 00:00:00' AS date")
    for r in pipeline.scored(raw, STAGED, tokens=tokens).collect():
        assert r.token_count == OWN.count(r.text) and r.chunk_count == len(chunks_of(r.text, counter=Plain()))


def test_new_pieces_are_merged_together(monkeypatch):
    alone, short = [], Ranks._merged_short
    monkeypatch.setattr(Ranks, "_merged_short", lambda self, piece: alone.append(piece) or short(self, piece))
    monkeypatch.setattr(bpe, "SLICE", 5000)
    monkeypatch.setattr(bpe, "KEEP_ENTRIES", 2000)  # far fewer than there are
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdehilnorst\u00e9\u65e5\U0001f600") for _ in range(rng.randrange(1, 16)))
    texts = [" ".join(w.capitalize() + rng.choice(["", ".", "?", "'s"]) for w in (word() for _ in range(60))) for _ in range(40)] + ["", "'Tis. 'Twas It's", "a" * 90 + " " + "z" * 70]
    texts += [t.encode("ascii", "ignore").decode() for t in texts]
    counter = BytePairs.__new__(BytePairs)
    monkeypatch.setattr(BytePairs, "ranks", lambda self: ranks)
    ranks = Ranks(RANKS)
    for limit in (10_000, 20):
        got = [measured(at, limit) for at in counter.layouts(iter(texts))]
        assert limit == 20 or len(alone) < 10
        assert got == [(len(LIBRARY.encode_ordinary(t)), [n for _, n, _ in chunks_of(t, limit, 1, Plain())]) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=70), st.text("abehilnorst ", min_size=1, max_size=70).map(str.encode)), min_size=1, max_size=20))
def test_merges_together_equal_those_alone(pieces):
    assert OWN.merges.counts(pieces).tolist() == [OWN._merged_short(p) for p in pieces]


def test_merges_of_a_vocabulary_without_some_bytes():
    few = Ranks({b"a": 0, b"b": 5, b"ab": 9, b"ca": 7, b"abab": 11})
    pieces = [b"cababa", b"ab", b"c", b"ccc", b"abababab", b"aab"]
    assert few.merges.counts(pieces).tolist() == [few._merged_short(p) for p in pieces]
    assert Ranks({}).merges.counts([b"abc", b"x"]).tolist() == [3, 1]


def test_a_file_too_large_is_no_vocabulary(spark, tmp_path, monkeypatch):
    (tmp_path / "v").write_bytes(b"YQ== 0\n" * 100)
    monkeypatch.setattr(BytePairs, "MOST", 100)
    with pytest.raises(ValueError, match="no vocabulary"):
        BytePairs.load(spark, f"file://{tmp_path}/v")
