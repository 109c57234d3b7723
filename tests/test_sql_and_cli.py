"""SQL functions and the command line's job."""

import json

import pytest

from corpusq import cli
from corpusq.functions import sql


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("""SELECT count_tokens('Hi, you!') AS n, split_sentences('One. Two') AS s, detect_pii('a@b.co or 555-123-4567') AS p, detect_pii(NULL) AS none,
        redact_pii('mail a@b.co') AS r, readiness_score('too_short', false, true) AS x, chunk_text('Great food! Will come back.')[0].sentences AS c, chunk_quality('').quality_flag AS q""").first()
    assert (r.n, r.s, r.p, r.none, r.r, r.x, r.c, r.q) == (4, ["One.", "Two"], ["email", "phone"], [], "mail [EMAIL REDACTED]", 42.0, 2, "empty")
    assert spark.sql("SELECT c.tokens FROM (SELECT explode_outer(chunk_text('a b c')) AS c)").first()[0] == 3


def test_job(spark, tmp_path):
    text = "A plain sentence of more than twenty words that the cleaning step is going to keep, because it is long enough for it. "
    rows = [{"review_id": str(i), "text": t, "stars": 4.0} for i, t in enumerate([text * 6, text * 6, "short", text + "a@b.co"])]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert cli.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")) == 2  # the copy scores 70
    assert cli.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), 71) == 1
    with pytest.raises(FileNotFoundError):
        cli.run(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert cli.arguments(["--input", "a", "--output", "b"]).min_score == 70
