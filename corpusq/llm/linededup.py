"""Line dedup with a log-template tree, in DataFrame functions only.

A line's tokens are its runs without white space; a token with a digit is a variable field and
reads `<*>`. The tree has a fixed depth: token count, then the LEAD first tokens. The leaf's
earliest line (by doc_id, then position) is its template; a line of the leaf belongs to it if at
least half of its tokens after the lead equal the template's at their positions, which generalises
the others to fields (the leaf makes the lead equal, so it says nothing). The earliest line too different
is the leaf's next template for those that are left, and so on as long as MIN_DOCS lines are left. A round takes one template
of every leaf and sees each different line once. A leaf that is still crowded after ROUNDS of them has its other templates read off its tokens, in
one step for any number of them: a token is fixed if MIN_DOCS of the leaf's remaining lines have it at its place, the others are fields, and lines with the
same fixed tokens at the same places, at least half of those after the lead, are one template. Lines that are left after that are
templates by themselves, shared by lines with the same masked tokens.
A template found in MIN_DOCS documents or more is recurring: all its lines are dropped but its
earliest one, so that a passage shared by copies stays once.

Shape of the plan: texts are masked once, into a table of lines; leaves that can't recur are found from
(leaf, doc_id) alone, with partial aggregation; only the lines of the others are compared. All joins are
equi-joins by leaf or template that AQE splits where a boilerplate line is hot, all counts are
combined before their shuffle, and the texts move once, by doc_id, when lines are taken out.

Defined results: lines are split at \\n; lines of fewer than min_tokens tokens are never dropped
(MIN_TOKENS as the SQL has it; with 1, lines of 1 to 4 tokens are templates by their whole masked line,
and those of fields only by their exact tokens, since a mere `<*>` is no boilerplate); a null text has one empty line; rows that share a doc_id count as one document whose decisions hold for
each of them; a null doc_id is a document, and the earliest; an empty table gives an empty result.
`find_drops` and `drop_lines` accept any other columns; `drop_lines` keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.plans.once import free_name, once, spread
from corpusq.plans.workspace import Workspace

MIN_TOKENS = 5
LEAD = 4
MIN_DOCS = 3
ROUNDS = 32
BLOCK_BITS = 10
#: A token with a digit, from its start on; single spaces part tokens.
FIELD = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"
#: A line of up to four tokens with digits and nothing else.
FIELDS_ONLY = r"\A(?:[^ 0-9]*+[0-9][^ ]*+(?: |\z)){1,4}\z"


def masked_lines(docs: DataFrame, exact_fields: bool = False) -> DataFrame:
    """doc_id, pos, masked (the tokens, single spaces between them, those with a digit as `<*>`), tokens (their number).

    A text is masked as a whole and then split, so a pattern runs once per document. With exact_fields a line
    of nothing but up to 4 fields keeps its own tokens.
    """
    text = F.coalesce("text", F.lit(""))
    spaced = F.regexp_replace(F.regexp_replace(text, r"[\t\x0B\f\r ]+", " "), " ?\n ?", "\n")
    df = once(docs.select("doc_id", "text"), plain=F.btrim(F.when(text.rlike(r"[\t\x0B\f\r]|  | \n|\n "), spaced).otherwise(text), F.lit(" "))).drop("text")
    df = once(df, masked=F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", FIELD, "<*>")).otherwise(F.col("plain")))
    if exact_fields:
        both = df.select("doc_id", F.posexplode(F.arrays_zip(F.split("masked", "\n").alias("m"), F.split("plain", "\n").alias("p"))).alias("pos", "line"))
        lines = both.select("doc_id", "pos", F.when(F.col("line.p").rlike(FIELDS_ONLY), F.col("line.p")).otherwise(F.col("line.m")).alias("masked"))
    else:
        lines = df.select("doc_id", F.posexplode(F.split("masked", "\n")).alias("pos", "masked"))
    spaces = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit("")))
    return lines.withColumn("tokens", F.when(F.col("masked") == "", 0).otherwise(spaces + 1))


def like(line: Column, template: Column, tokens: Column) -> Column:
    """Whether at least half of the line's tokens after the lead equal those of the template, a line of the same length and lead."""
    same = F.aggregate(F.zip_with(F.split(line, " "), F.split(template, " "), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    lead = F.least(tokens, F.lit(LEAD))
    return F.when(line == template, True).otherwise(2 * (same - lead) >= tokens - lead)


def find_drops(docs: DataFrame, ws: Workspace, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id and drops (block of 1,024 positions -> positions) for documents that lose lines."""
    lines = ws.save("all", masked_lines(docs, min_tokens < MIN_TOKENS).where(F.col("tokens") >= min_tokens))
    lead = F.substring_index("masked", " ", LEAD)
    lines = lines.select("doc_id", "pos", "tokens", "masked", F.xxhash64("tokens", lead).alias("k1"), F.xxhash64(F.lit(1), lead, "tokens").alias("k2"))

    leaves = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    several = F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | F.col("named").between(1, F.col("n") - 1)
    leaves = leaves.where((F.col("n") >= min_docs) & several).select("k1", "k2")
    found = ws.save("lines", lines.join(spread(leaves), ["k1", "k2"]).select("k1", "k2", "masked", "tokens", "doc_id", "pos"))
    ws.drop("all")

    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "pos")
    kinds = ws.save("kinds", found.groupBy("k1", "k2", "masked", "tokens").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")))
    named = ws.save("named", templates(kinds, ws, min_docs))
    keyed = ws.save("keyed", found.join(spread(named), ["k1", "k2", "masked"]).select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "doc_id", "pos"))
    for name in ("lines", "kinds", "named"):
        ws.drop(name)
    per_doc = keyed.groupBy("k1", "k2", "doc_id").agg(F.min("pos").alias("pos"))
    recurring = per_doc.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where(F.col("n") >= min_docs).select("k1", "k2", "at")
    gone = keyed.join(spread(recurring), ["k1", "k2"]).where(~(F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("pos") == F.col("at.pos"))))
    blocks = gone.groupBy("doc_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.collect_set("pos").alias("positions"))
    return blocks.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "positions"))).alias("drops"))


def templates(kinds: DataFrame, ws: Workspace, min_docs: int) -> DataFrame:
    """k1, k2, masked of kinds (k1, k2 of a leaf, masked, tokens, their earliest place at, their lines n) with t1, t2 of their template."""
    rest, out = kinds, []
    for i in range(ROUNDS + 1):
        crowded = rest.groupBy("k1", "k2").agg(F.min_by("masked", "at").alias("template"), F.sum("n").alias("lines")).where(F.col("lines") >= min_docs).drop("lines")
        crowded = ws.save(f"crowded-{i}", crowded)
        if i == ROUNDS or crowded.isEmpty():
            break
        fits = F.coalesce(like(F.col("masked"), F.col("template"), F.col("tokens")), F.lit(False))
        tried = ws.save(f"tried-{i}", once(rest.join(spread(crowded), ["k1", "k2"], "left"), fits=fits, held=F.col("template").isNotNull()).drop("template"))
        out.append(tried.where("fits").select("k1", "k2", "masked", *[F.xxhash64(F.lit(f"{k}-{i}"), k).alias(t) for k, t in (("k1", "t1"), ("k2", "t2"))]))
        out.append(_by_line(tried.where("not held")))
        rest = tried.where("held and not fits").drop("fits", "held")
    out.append(by_fixed_tokens(rest, crowded.select("k1", "k2"), min_docs) if i == ROUNDS else _by_line(rest))
    return reduce(DataFrame.unionByName, out)


def _by_line(kinds: DataFrame) -> DataFrame:
    return kinds.select("k1", "k2", "masked", F.xxhash64(F.lit(2), "masked").alias("t1"), F.xxhash64(F.lit(3), "masked").alias("t2"))


def by_fixed_tokens(kinds: DataFrame, crowded: DataFrame, min_docs: int) -> DataFrame:
    """As `templates`, from the tokens that min_docs lines of a crowded leaf have at one place.

    Tokens travel as hashes with their places; a line's fixed ones are summed up in any order by exclusive or.
    """
    line = F.xxhash64("masked").alias("line")
    each = kinds.join(spread(crowded), ["k1", "k2"], "left_semi").select("k1", "k2", "n", line, F.posexplode(F.split("masked", " ")).alias("i", "token")).where(F.col("i") >= LEAD)
    each = each.select("k1", "k2", "line", "n", F.xxhash64("k1", "i", "token").alias("x1"), F.xxhash64("k2", "token", "i").alias("x2"))
    fixed = each.groupBy("x1", "x2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).drop("n")
    of_line = each.drop("n").join(spread(fixed), ["x1", "x2"]).groupBy("k1", "k2", "line").agg(F.count(F.lit(1)).alias("same"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    at = kinds.withColumn("line", line).join(of_line, ["k1", "k2", "line"], "left")
    shared = F.coalesce(2 * F.col("same") >= F.col("tokens") - LEAD, F.lit(False))
    keys = [F.when(shared, F.xxhash64(F.lit(a), k, x)).otherwise(F.xxhash64(F.lit(b), "masked")).alias(t) for k, x, t, a, b in (("k1", "x1", "t1", 4, 2), ("k2", "x2", "t2", 5, 3))]
    return at.select("k1", "k2", "masked", *keys)


def _with_kept(docs: DataFrame, ws: Workspace, min_docs: int, min_tokens: int) -> tuple[DataFrame, Column, Column]:
    """(docs with a column of its own for the drops, the lines, the lines that stay); no column of docs is touched."""
    doc, drops = free_name(docs, "drops_of"), free_name(docs, "drops")
    found = find_drops(docs, ws, min_docs, min_tokens).select(F.col("doc_id").alias(doc), F.col("drops").alias(drops))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def stays(_, i):
        return ~F.coalesce(F.array_contains(F.try_element_at(drops, F.shiftright(i, BLOCK_BITS)), i), F.lit(False))

    out = docs.join(found, docs["doc_id"].eqNullSafe(F.col(doc)), "left").drop(doc)
    return out, lines, F.when(F.col(drops).isNull(), lines).otherwise(F.filter(lines, stays))


def report(docs: DataFrame, ws: Workspace, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 for every row of docs."""
    out, lines, kept = _with_kept(docs.select("doc_id", "text"), ws, min_docs, min_tokens)
    out = once(out.select("doc_id", lines.alias("all_lines"), kept.alias("kept_lines")), all_lines=F.size("all_lines"), kept_lines=F.size("kept_lines"), kept=F.array_join("kept_lines", "\n"))
    return out.select(
        "doc_id",
        F.col("all_lines").cast("long").alias("n_lines"),
        (F.col("all_lines") - F.col("kept_lines")).cast("long").alias("n_dropped"),
        F.length("kept").cast("long").alias("kept_chars"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, ws: Workspace, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows of docs with the text of their remaining lines; n_chars, if there, is made to fit. All other columns stay, whatever their names.

    A row that loses lines and has no other left is dropped.
    """
    out, lines, kept = _with_kept(docs, ws, min_docs, min_tokens)
    state, drops = free_name(docs, "kept_lines"), free_name(docs, "drops")
    out = out.withColumn(state, F.when(F.col(drops).isNotNull(), kept)).where(F.col(state).isNull() | (F.size(state) > 0))
    fewer = F.col(state).isNotNull() & (F.size(state) < F.size(lines))
    text = F.array_join(state, "\n")
    new = {"text": F.when(fewer, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(fewer, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])



FIELDS_ONLY_SQL = r"[\x20\x09-\x0D]*([^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*[\x20\x09-\x0D]+){0,3}[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*[\x20\x09-\x0D]*"


def oracle(min_tokens: int) -> str:
    """DuckDB SQL for `report` of documents: kinds of lines go from round to round until they fit."""
    field = "regexp_matches(x, '[0-9]')" + (f" AND NOT regexp_full_match(line, '{FIELDS_ONLY_SQL}')" if min_tokens < MIN_TOKENS else "")
    fits = f"(k = template OR len(k) > {LEAD} AND 2 * len(list_filter(range({LEAD + 1}, len(k) + 1), lambda j: k[j] = template[j])) >= len(k) - {LEAD})"
    return rf"""
WITH RECURSIVE lines AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)
), toks AS (
  SELECT doc_id, pos, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN {field} THEN '<*>' ELSE x END) AS k FROM lines
), cand AS MATERIALIZED (SELECT doc_id, pos, k, {{'n': len(k), 'lead': k[1:{LEAD}]}} AS leaf FROM toks WHERE len(k) >= {min_tokens}),
rounds AS (
  SELECT leaf, k, min({{'d': doc_id, 'p': pos}}) AS place, count(*) AS n, 0 AS round FROM cand GROUP BY leaf, k
  UNION ALL
  SELECT leaf, k, place, n, round + 1 FROM (SELECT *, first_value(k) OVER (PARTITION BY leaf ORDER BY place) AS template, sum(n) OVER (PARTITION BY leaf) AS lines FROM rounds)
  WHERE round < {ROUNDS} AND lines >= {MIN_DOCS} AND NOT {fits}
),
last AS MATERIALIZED (SELECT leaf, k, n, round, (SELECT sum(n) FROM rounds o WHERE o.leaf = r.leaf AND o.round = r.round) >= {MIN_DOCS} AS crowded
  FROM (SELECT leaf, k, any_value(n) AS n, max(round) AS round FROM rounds GROUP BY leaf, k) r),
places AS (SELECT leaf, k, n, i, k[i] AS token FROM last, unnest(range({LEAD + 1}, len(k) + 1)) AS u(i) WHERE crowded AND round = {ROUNDS}),
fixed AS (SELECT leaf, i, token FROM places GROUP BY ALL HAVING sum(n) >= {MIN_DOCS}),
generalised AS (SELECT leaf, k, count(*) AS n, string_agg(p.i || ':' || p.token, ' ' ORDER BY p.i) AS template FROM places p JOIN fixed f USING (leaf, i, token) GROUP BY leaf, k),
named AS (SELECT l.leaf, l.k, CASE WHEN crowded AND round < {ROUNDS} THEN 'T' || round || ' ' || CAST(l.leaf AS VARCHAR) WHEN 2 * g.n >= len(l.k) - {LEAD} THEN 'G ' || CAST(l.leaf AS VARCHAR) || ' ' || template ELSE 'M ' || array_to_string(l.k, ' ') END AS key
  FROM last l LEFT JOIN generalised g ON l.leaf = g.leaf AND l.k = g.k),
keyed AS (SELECT doc_id, pos, key FROM cand JOIN named ON cand.leaf = named.leaf AND cand.k = named.k),
recurring AS (
  SELECT key, min({{'d': doc_id, 'p': pos}}) AS first FROM keyed GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), gone AS (
  SELECT k.doc_id, k.pos FROM keyed k JOIN recurring r ON k.key = r.key WHERE k.doc_id <> r.first.d OR k.pos <> r.first.p
), kept AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS dropped FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
), texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept FROM kept GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM texts
"""


ORACLE, ORACLE_ALL = oracle(MIN_TOKENS), oracle(1)
