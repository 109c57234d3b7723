"""Column functions on text: all are built-in expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: a sentence ends at . ! or ? before white space and a capital letter, or at the end.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])$"
#: What words are made of, as in the SQL: not the joiners and circled letters that \w has too.
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
#: A token is a run of word characters or one other mark. An approximation of byte-pair counts.
TOKEN = rf"[{WORD}]+|[^{WORD}\s\x0b\x85\p{{Z}}]"
SPACES = r"(?U)\s+"


#: The characters with the property White_Space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _count_runs(c: Column, run: str) -> Column:
    """Runs of `run` and other characters that aren't white space: each run becomes one letter, then letters and marks are counted."""
    return F.length(F.translate(F.regexp_replace(c, run, "a"), BLANKS, ""))


def count_tokens(c: Column) -> Column:
    return F.when(is_ascii(c), _count_runs(c, r"\w+")).otherwise(_count_runs(c, f"[a-zA-Z0-9_{WORD}]+"))


def count_words(c: Column) -> Column:
    return _count_runs(c, r"(?U)\S+")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda x: x != "")


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), strip), lambda x: x != "")


def ascii_share(c: Column) -> Column:
    """Share of characters below U+0080; null for an empty text."""
    return F.when(F.length(c) == 0, None).when(is_ascii(c), 1.0).otherwise(F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", "")) / F.length(c))


def is_mostly_ascii(c: Column, share: float = 0.9) -> Column:
    return F.coalesce(ascii_share(c) >= share, F.lit(False))


def preview(c: Column, n: int = 100, mark: str = "") -> Column:
    return F.concat(F.substring(c, 1, n), F.lit(mark))


def matches(query: str, *columns: Column, literal: bool = False) -> Column:
    """Case-insensitive search in any of the columns; the query is a pattern unless literal."""
    out = F.lit(False)
    for c in columns:
        hit = F.contains(F.lower(c), F.lit(query.lower())) if literal else c.rlike("(?iU)" + query)
        out = out | F.coalesce(hit, F.lit(False))
    return out


def json_list(c: Column) -> Column:
    """An array of strings as JSON text with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))


def from_json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def month_of(c: Column) -> Column:
    return F.date_trunc("month", c.cast("timestamp"))

