"""Chat formatting, BPE and quality rules against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import bpe, chat, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b b", "é#", "\n", " ", "\t", "the <cat> sat", "x\n", " y"]), max_size=120).map(" ".join))
def test_quality_equals_plain(text):
    assert quality.judge(text.encode())[:6] == plain_quality(text)


def test_coverages_and_verdict():
    eight = " ".join(f"w{i}" for i in range(8))
    own = " ".join(f"v{i}" for i in range(100))
    names = quality.fields().names
    got = dict(zip(names, quality.judge(f"{eight}\n{own}\n{eight}\n".encode())))
    assert got["repeated_8gram_chars"] == got["repeated_5gram_chars"] == 32 and got["repeated_10gram_chars"] == 0
    assert got["repeated_line_chars"] == 16 and got["n_dup_lines"] == 1 and got["kept"]
    got = dict(zip(names, quality.judge(f"{own} {eight} {eight} {eight} {eight}".encode())))
    assert got["n_repeat_words"] == 32 and not got["base_failed"] and got["kept"]
    strict = quality.Rules(ngram_limits=((5, 0.1),))
    got = dict(zip(quality.fields(strict).names, quality.judge(f"{own} {eight} {eight} {eight} {eight}".encode(), strict)))
    assert got["repeated_5gram_chars"] == 64 and not got["kept"] and not got["base_failed"]


def test_quality_table(docs):
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    got = {r.doc_id: r for r in quality.measure(docs([None, "", clean, "spam eggs ham. " * 60, (2, clean), "x " * 500_000], extra=True)).collect() if r.doc_id != 2}
    assert got[0].base_failed and got[1].base_failed and not got[0].kept
    assert got[3].base_failed and got[5].n_words == 500_000
    kept = quality.keep_good(docs([None, clean, (1, clean), "a a"], extra=True))
    assert [r.doc_id for r in kept.collect()] == [1, 1] and kept.columns[-2:] == ["kept", "component_id"]
    assert quality.measure(docs([])).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


PIECES = ["'s", "'", "''s", "!'ll", "  ", "\n", "\n\n", " ", "a", "Zq", "9", " ", "　", "é", "ß", "Ж", "\U0001f600", "<|endoftext|>", "<|", "\x1c", "\x85", "\t", "\r\n", "the", " don't", "你好", " ", "#!?", "'re", "́", "\x00"]


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.text(max_size=40)))
def test_bpe_equals_library(library, text):
    c = bpe.codec(bpe.default_path())
    want = library.encode(text, add_special_tokens=False).ids
    ids = c.encode(text.encode())
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert c.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_table(docs, library):
    texts = [None, "", "Hello  world's\n\n end", "x" * 200_000, "Hello  world's\n\n end", "a b c " * 30_000]
    got = {r.doc_id: r for r in bpe.digests(docs(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(texts)).withColumnRenamed("text", "was"))
    assert all(r.text == (r.was or "") for r in back.collect())
    assert bpe.digests(docs([])).count() == 0


def test_bpe_ways_agree(library, monkeypatch):
    rng = random.Random(12)
    c = bpe.Codec(bpe.default_path())
    words = [rng.choice(["", " "]) + "".join(rng.choice("aeiouthnsrlABCßéñü") for _ in range(rng.randrange(1, 24))) for _ in range(4000)]
    words += [" " + str(rng.randrange(10**9)) for _ in range(500)]
    pieces = [w.encode() for w in words if bpe.ONE_PIECE.fullmatch(w.encode())]
    assert c.merge is not None and len(pieces) == len(words)
    assert [c.merge(x) for x in pieces] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "KEEP_ENTRIES", 50)
    few, plain = bpe.Codec(bpe.default_path()), bpe.Codec(bpe.default_path())
    plain.merge = None
    for _ in range(30):
        text = "".join(rng.choices([*words[:300], " don't", "\n\n", "<|endoftext|>", "你好"], k=200)).encode()
        assert few.encode(text) == plain.encode(text) == c.encode(text)
        assert len(few.known) <= 50 and len(few.known.old) <= 50


def test_bpe_makes_cuts():
    parts = bpe.codec(bpe.default_path()).fragments(b"The quick brown fox, 12 times.")
    assert b"".join(parts) == b"The quick brown fox, 12 times." and len(parts) > 5


MARKS = ["<s>", "</s>", "[INST]", " [/INST]", "\\", "<", "[", "]", " ", "a", "\n", "[ROLE=", " [/ROLE]", "é", "\U0001f600", "\\\\", "\\<"]
TEXTS = st.lists(st.sampled_from(MARKS), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXTS), TEXTS), max_size=5))
def test_chat_round_trip(turns):
    segments = [chat.format_turn(r, t)[0] for r, t in turns]
    assert chat.parse_all("".join(segments)) == turns


def test_chat_escapes_only_conflicts():
    assert chat.format_turn("user", "a < b \\ c")[0] == "<s>[INST] a < b \\ c [/INST]"
    assert "\\" in chat.format_turn("assistant", "</s>[INST] ok [/INST]")[0]


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "yes</s>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 2, "assistant", "é"), (1, 2, "assistant", "é")]
    rows += [(3, i, "user", "y" * 1000) for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns")
    got = {r.conv_id: r for r in chat.digests(frame).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\n\nassistant\nyes</s>\nassistant\né\nassistant\né\n")
    assert got[1].loss_chars == 9 and got[1].loss_sha256 == sha("yes</s>éé")
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].n_turns == 1 and got[3].n_turns == 3000
    spans = [r for r in chat.format_turns(frame).collect() if r.conv_id == 1 and r.loss_start is not None]
    assert [chat.ESCAPED.sub(r"\1", r.rendered[r.loss_start : r.loss_end]) for r in sorted(spans, key=lambda r: r.turn)] == ["yes</s>", "é", "é"]
    assert chat.digests(frame.limit(0)).count() == 0


def test_conversations_are_read_back_as_a_whole(spark, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(chat, "READ_CHARS", 50)
    digest = chat._Digest(1)
    turns = [(rng.choice(["user", "assistant", "system", "a]b"]), "".join(rng.choices(MARKS, k=rng.randrange(9)))) for _ in range(200)]
    for turn in turns:
        digest.add(*turn)
    loss = "".join(t for r, t in turns if r == "assistant")
    row = digest.row()
    assert row[1] == 200 and row[2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert row[3:5] == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert row[5:] == (len(whole), hashlib.sha256(whole.encode()).hexdigest()) and chat.parse_all(whole) == turns
