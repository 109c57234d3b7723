"""Personal data: patterns propose spans, checksums confirm them, and words nearby move their score.

Four base kinds (email, ip, card, phone) are the leftmost matches of a pattern, without overlap within a
kind; a match that fails its check (parts up to 255, Luhn, number of digits) is dropped and nothing of it
is tried again. Base spans always stay. Three more kinds are reported from a score of LEAST on: iban
(mod-97), ssn (numbers that can have been given out) and national (a telephone number without a country), of
which the latter two need a word such as `call` nearby, and never lie over a base span. A score starts
from the kind's own, a word for it within BEFORE characters in front or AFTER behind adds BONUS, one
against it in front takes BONUS away; so base spans can be ranked or filtered by score too.

Work is row-local: there is no shuffle, memory is bounded by one text and its spans, and each scan of a text is
linear, as an attempt never starts again inside a run that has failed.

Defined results: positions are code points, the end exclusive; a null or empty text has no spans; invalid UTF-8 reads as U+FFFD;
repeated rows are searched each by itself; an empty table gives an empty result. `find_spans` and `digests` ignore other columns,
`mask` keeps them whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.batches import pieces, text_bytes
from corpusq.plans.once import once

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "national")
BEFORE, AFTER = 40, 20
BONUS, LEAST = 30, 70
OWN_SCORE = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 40, "national": 40}
# Words that speak for a kind, and in front of a span against it; in small letters.
FOR = {
    "email": r"e-?mails?|mailto|contact|write|reach",
    "ip": r"ip|address|host|server|client|login",
    "card": r"cards?|visa|mastercard|amex|payment|credit|debit",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|telefon|handy|t[eé]l[eé]phone|tel[eé]fono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security",
    "national": r"phone|tel|telephone|mobile|cell|call|fax|telefon|handy|t[eé]l[eé]phone|tel[eé]fono",
}
AGAINST = {
    "email": r"noreply|no-reply",
    "ip": r"version|release|section",
    "card": r"order|invoice|tracking|isbn|serial",
    "phone": r"order|invoice|tracking|isbn|serial",
    "iban": r"order|invoice|tracking|isbn|serial",
    "ssn": r"order|invoice|tracking|isbn|serial|part",
    "national": r"order|invoice|tracking|isbn|serial|part",
}
#: Characters of an account number by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
NATIONAL = r"(?:\b|\()[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b"
_MORE = {"iban": re.compile(IBAN, re.A), "ssn": re.compile(SSN, re.A), "national": re.compile(NATIONAL, re.A)}
_FOR = {k: re.compile(rf"\b(?:{p})\b", re.A) for k, p in FOR.items()}
_AGAINST = {k: re.compile(rf"\b(?:{p})\b", re.A) for k, p in AGAINST.items()}
_LOWER = {c: c + 32 for c in range(65, 91)}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: int


def passes_luhn(digits: str) -> bool:
    """Every second digit from the right doubled (its digits summed), the sum divisible by ten."""
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def passes_mod97(code: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the local part is the run before it, back to the match or @ before; the domain follows."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        low = at + 1
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", low)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The confirmed spans of the base kinds."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = list(_emails(text))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and passes_luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _iban_end(found: str) -> int:
    """Where the country's length ends, if a space follows there: what comes after is a word in capitals."""
    need, places = IBAN_LENGTH.get(found[:2], 0), [i for i, c in enumerate(found) if c != " "]
    return places[need - 1] + 1 if 0 < need < len(places) and found[places[need - 1] + 1] == " " else len(found)


def _more(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """The other kinds' confirmed spans."""
    for m in _MORE["iban"].finditer(text):
        end = _iban_end(m[0])
        if passes_mod97(m[0][:end].replace(" ", "")):
            yield "iban", m.start(), m.start() + end
    taken = None
    for kind in ("ssn", "national"):
        for m in _MORE[kind].finditer(text):
            if kind == "ssn" and (m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000"):
                continue
            if taken is None:
                taken = sorted(s for spans in base.values() for s in spans)
                starts, reach = [s[0] for s in taken], [0, *accumulate((s[1] for s in taken), max)]
            if reach[bisect_left(starts, m.end())] <= m.start():  # no base span that starts before its end reaches into it
                yield kind, *m.span()


def score_of(text: str, kind: str, start: int, end: int) -> int:
    """Of 0 to 110: the kind's own score, and BONUS up or down by the words nearby."""
    before, after = text[max(0, start - BEFORE) : start].translate(_LOWER), text[end : end + AFTER].translate(_LOWER)
    good = bool(_FOR[kind].search(before) or _FOR[kind].search(after))
    return OWN_SCORE[kind] + BONUS * good - BONUS * bool(_AGAINST[kind].search(before))


def spans_of(text: str, least: int = LEAST) -> list[Span]:
    """All base spans, and the others of a score of `least` or more, by start and then in the order of KINDS."""
    base = base_spans(text)
    out = [Span(i, j, k, score_of(text, k, i, j)) for k, spans in base.items() for i, j in spans]
    more = (Span(i, j, k, score_of(text, k, i, j)) for k, i, j in _more(text, base))
    out += [s for s in more if s.score >= least]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,score:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32())]))


def find_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in spans_of(t.decode("utf-8", "replace"), least)] for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row; the strings list kind:start:end, and scores in the order of spans."""
    found = find_spans(docs, least)
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    out = once(
        found.select("doc_id", "spans"),
        **{f"n_{k}": number(k) for k in BASE},
        base_sha256=F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256),
        listed=F.array_join(F.transform("spans", place), ","),
        scores=F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ","),
    )
    return out.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", F.col("listed").alias("spans"), "scores")


def masked(text: str, spans: list[Span]) -> str:
    """The text with `[KIND]` in place of each span; of spans that overlap, the outermost start counts and the longest reach."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with personal data replaced in text; a null text stays null, n_chars is left as it is."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            texts = [t.decode("utf-8", "replace") for t in text_bytes(b.column(at))]
            new = [masked(t, [s for s in spans_of(t, least) if s.score >= least]) for t in texts]
            column = pa.array([n if v else None for n, v in zip(new, b.column(at).is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _oracle() -> str:
    """DuckDB SQL for `digests`: matches are placed by the lengths of what lies between them."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": IBAN,
        "ssn": SSN,
        "national": NATIONAL,
    }
    each = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, {i} AS ord, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for i, (k, p) in enumerate(patterns.items()))
    lengths = ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTH.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    match = lambda c, words: "CASE kind " + " ".join(rf"WHEN '{k}' THEN regexp_matches({c}, '\b(?:{p})\b')" for k, p in words.items()) + " END"
    own = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in OWN_SCORE.items()) + " END"
    base = "('" + "', '".join(BASE) + "')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({each}),
placed AS (SELECT doc_id, t, kind, ord, m[j] AS x, CAST(list_sum(list_transform(g[1:j], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda s: length(s))), 0) AS BIGINT) AS a FROM f, unnest(range(1, len(m) + 1)) AS u(j)),
cut AS (SELECT * REPLACE (CASE WHEN kind = 'iban' AND len(c) > need AND x[c[need] + 1] = ' ' THEN x[1:c[need]] ELSE x END AS x)
  FROM (SELECT *, list_filter(range(1, length(x) + 1), lambda i: x[i] <> ' ') AS c, coalesce(map_extract_value(MAP {{{lengths}}}, x[1:2]), 1000) AS need FROM placed)),
n AS (SELECT doc_id, t, kind, ord, x, a, a + length(x) AS z, regexp_replace(x, '[^0-9]', '', 'g') AS digits, replace(x, ' ', '') AS code FROM cut),
luhn AS (SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[-i] AS INTEGER) ELSE CAST(digits[-i] AS INTEGER) * 2 - CASE WHEN digits[-i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0 AS luhn FROM n),
ok AS (SELECT * FROM luhn WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND luhn
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(code[5:] || code[1:4], ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda p, v: (p * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
  WHEN 'ssn' THEN x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:11] <> '0000'
  ELSE true END),
near AS (SELECT *, {lower.format(f't[greatest(a - {BEFORE}, 0) + 1:a]')} AS before, {lower.format(f't[z + 1:z + {AFTER}]')} AS after FROM ok),
scored AS (SELECT doc_id, kind, ord, a, z, {own} + CASE WHEN {match('before', FOR)} OR {match('after', FOR)} THEN {BONUS} ELSE 0 END - CASE WHEN {match('before', AGAINST)} THEN {BONUS} ELSE 0 END AS score FROM near),
s AS (SELECT * FROM scored WHERE kind IN {base} OR (score >= {LEAST} AND (kind = 'iban' OR NOT EXISTS (SELECT 1 FROM scored b WHERE b.doc_id = scored.doc_id AND b.kind IN {base} AND b.a < scored.z AND scored.a < b.z)))),
w AS (SELECT *, kind || ':' || a || ':' || z AS place FROM s)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg(place, ',' ORDER BY a, ord) FILTER (kind IN {base}), '')) AS base_sha256,
  coalesce(string_agg(place, ',' ORDER BY a, ord), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, ord), '') AS scores
FROM d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
