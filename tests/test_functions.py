"""Text, chunk, personal-data and score functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusq.functions import chunk, pii, score, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Great restaurant, no complaints!", []),
        ("Write to john@example.com today", ["email"]),
        ("Call us at 555-123-4567 to make a booking.", ["address", "phone"]),
        ("We're located at 123 Main Street in downtown.", ["address"]),
        ("Mail jane.doe@company.com or (555) 987-6543. Visit 456 Oak Ave!", ["address", "email", "phone"]),
        ("Great! Call me at 555-1234 if you want.", ["address"]),
        ("Send to P.O. Box 77", ["address"]),
        ("", []),
        (None, []),
        (" \n", []),
    ],
)
def test_pii(spark, value, want):
    assert one(spark, value, pii.pii_types) == want


def test_redact(spark):
    r = one(spark, "Mail john.doe@example.com or call 555-123-4567 now", pii.redact)
    assert r["redacted_text"] == "Mail [EMAIL REDACTED] or call [PHONE REDACTED] now" and r["total_redactions"] == 2 and r["redactions_made"] == {"email": 1, "phone": 1}
    assert one(spark, "card 4532-1234-5678-9010 ok", pii.redact)["redacted_text"] == "card [CARD REDACTED] ok"
    assert one(spark, "call (555) 987-6543 now", pii.quick_redact) == "call (555) 987-6543 now"
    assert one(spark, "a@b.co", lambda c: pii.redact(c, [])["redacted_text"]) == "a@b.co"
    assert one(spark, "a@b.co 555-123-4567", lambda c: pii.redact(c, ["phone", "unknown"], "generic")["redacted_text"]) == "a@b.co our phone number"
    assert one(spark, "  ", pii.redact)["redaction_rate"] == 0.0


TEXTS = [
    None,
    "",
    "   ",
    "Great food! Will come back.",
    "Dr. Smith came. He left.\n",
    " ".join(["This restaurant has amazing food and excellent service every day."] * 50),
    " ".join("Word%d" % i for i in range(1300)) + ". Then more text here. " * 90,
    " ".join(["w"] * 399 + ["End."]) + " " + " ".join(["Again"] + ["w"] * 398 + ["end."]) + " " + " ".join(["And"] + ["w"] * 398 + ["end."]),
    "é " * 700 + "\U0001f600 done. Next one!",
]


def test_chunk_fold_equals_kernel(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for r in df.select("i", "t", chunk.chunk_text(F.col("t")).alias("c")).collect():
        assert [(c["text"], c["tokens"], c["sentences"]) for c in r["c"]] == chunk.chunks_of(r["t"]), r["i"]
        assert [c["chunk_id"] for c in r["c"]] == list(range(len(r["c"])))
    stats = df.select(chunk.chunk_stats(F.col("t")).alias("s"), chunk.chunk_quality(chunk.chunk_text(F.col("t"))).alias("q")).collect()
    for r in stats:
        assert tuple(r["s"]) == tuple(r["q"])


def test_chunk_cases():
    assert chunk.chunks_of("Great food! Will come back.")[0][2] == 2
    many = chunk.chunks_of(TEXTS[5])
    assert len(many) > 1 and many[1][0].startswith(many[0][0].rsplit(". ", 1)[1][:20])
    assert max(n for _, n, _ in chunk.chunks_of(TEXTS[7])) > 500
    assert chunk.quality_of([]) == (0, 0.0, 0, 0, "empty")
    assert [chunk.quality_of([n])[4] for n in (99, 100, 800, 801)] == ["too_short", "optimal", "optimal", "too_long"]
    assert [chunk.quality_of([n, n])[4] for n in (199, 200, 600, 601)] == ["too_short", "optimal", "optimal", "too_long"]


def test_text(spark):
    assert one(spark, "  a b\n ", text.strip) == "a b"
    assert one(spark, "Hi, you_2! é", text.count_tokens) == 5
    assert one(spark, "One. Two? three! Four", text.split_sentences) == ["One.", "Two? three!", "Four"]
    assert one(spark, "abé", text.ascii_share) == pytest.approx(2 / 3) and one(spark, "", text.is_mostly_ascii) is False
    assert one(spark, None, lambda c: text.matches("x", c)) is False
    assert one(spark, "a.b", lambda c: text.matches("A.B", c, literal=True)) is True


@pytest.mark.parametrize(("variant", "flag", "dup", "has", "want"), [(score.STAGED, "too_short", False, False, (72.0, "index")), (score.STAGED, "too_short", False, True, (42.0, "reject")), (score.CLI, "too_short", False, False, (80.0, "index")), (score.API, "too_short", False, True, (50.0, "review")), (score.API, "strange", False, False, (80.0, "index")), (score.STAGED, "optimal", True, True, (40.0, "reject"))])
def test_scores(spark, variant, flag, dup, has, want):
    df = spark.createDataFrame([(flag, dup, has)], "chunk_quality_flag string, is_duplicate boolean, has_pii boolean")
    r = score.with_scores(df, variant).first()
    assert (r.index_readiness_score, r.recommendation) == want
