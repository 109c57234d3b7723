"""DuckDB SQL for the layers, written from the definitions and not from the engine's plans."""

WS = r"[\s\x0b\x{85}\p{Z}]"
STRIP = rf"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
TOKENS = r"len(regexp_extract_all(%s, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0b\x{85}\p{Z}]'))"
EDGE = r"(?:^|[^\p{L}\p{N}_])"
END = r"(?:$|[^\p{L}\p{N}_])"
EMAIL = EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + END
PHONE = rf"{EDGE}\d{{3}}[-.\s]?\d{{3}}[-.\s]?\d{{4}}{END}|\(\d{{3}}\)\s*\d{{3}}[-.\s]?\d{{4}}{END}|\+\d{{1,3}}\s*\d{{3}}\s*\d{{3}}\s*\d{{4}}{END}|{EDGE}\d{{10}}{END}"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct"
ADDRESS = rf"{EDGE}\d+\s+[A-Z][a-z]+\s+(?:{STREETS}){END}|{EDGE}P\.?O\.?\s+Box\s+\d+{END}|{EDGE}\d+\s+[A-Z][a-z]+\s+[A-Z][a-z]+{END}"


def tokens(c):
    return TOKENS % c


def strip(c):
    return STRIP % c


RAW = """
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS user_id, lang AS business_id, CAST(1 + doc_id % 5 AS DOUBLE) AS stars,
         doc_id % 7 AS useful, doc_id % 3 AS funny, doc_id % 2 AS cool, text,
         strftime(CAST('2020-01-01' AS DATE) + CAST(doc_id % 730 AS INTEGER), '%Y-%m-%d') || ' 00:00:00' AS date
  FROM documents
)"""


def silver(do_strip=True, ascii=True, min_tokens=20):
    """CTEs up to silver."""
    text = strip("text") if do_strip else "text"
    where = [f"{strip('text')} <> ''"]
    if min_tokens:
        where.append(f"{tokens(text)} >= {min_tokens}")
    if ascii:
        where.append(f"CAST(length(regexp_replace({text}, '[^\\x00-\\x7F]', '', 'g')) AS DOUBLE) / length({text}) >= 0.9")
    return f"""{RAW}, silver AS MATERIALIZED (
  SELECT review_id, user_id, business_id, stars, useful, funny, cool, date, {text} AS text, CAST({tokens(text)} AS INTEGER) AS token_count
  FROM raw WHERE text IS NOT NULL AND {' AND '.join(where)}
)"""


SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"

CHUNKS = rf"""
parted AS MATERIALIZED (SELECT review_id, text, token_count, {SENTENCES} AS l FROM silver),
sent AS MATERIALIZED (
  SELECT review_id, i, l[i] AS s, CAST({tokens('l[i]')} AS INTEGER) AS t
  FROM parted, unnest(range(1, len(l) + 1)) AS u(i) WHERE token_count > 500
),
fold AS (
  SELECT review_id, CAST(0 AS BIGINT) AS i, len(l) AS n, CAST(NULL AS BIGINT) AS a, 0 AS used, 0 AS last_t,
         CAST([] AS STRUCT(a BIGINT, b BIGINT, used INTEGER)[]) AS out
  FROM parted WHERE token_count > 500
  UNION ALL
  SELECT f.review_id, f.i + 1, f.n,
         CASE WHEN s.t > 500 THEN NULL WHEN f.used + s.t > 500 THEN CASE WHEN f.a IS NULL THEN f.i + 1 ELSE f.i END ELSE coalesce(f.a, f.i + 1) END,
         CAST(CASE WHEN s.t > 500 THEN 0 WHEN f.used + s.t > 500 THEN CASE WHEN f.a IS NULL THEN 0 ELSE f.last_t END + s.t ELSE f.used + s.t END AS INTEGER),
         s.t,
         CASE WHEN s.t > 500 THEN list_concat(CASE WHEN f.a IS NULL THEN f.out ELSE list_append(f.out, {{'a': f.a, 'b': f.i, 'used': f.used}}) END,
                                              [{{'a': f.i + 1, 'b': f.i + 1, 'used': -1}}])
              WHEN f.used + s.t > 500 AND f.a IS NOT NULL THEN list_append(f.out, {{'a': f.a, 'b': f.i, 'used': f.used}})
              ELSE f.out END
  FROM fold f JOIN sent s ON s.review_id = f.review_id AND s.i = f.i + 1
),
done AS (
  SELECT review_id, CASE WHEN a IS NULL THEN out ELSE list_append(out, {{'a': a, 'b': n, 'used': used}}) END AS out FROM fold WHERE i = n
),
spans AS (SELECT d.review_id, k, d.out[k].a AS a, d.out[k].b AS b, d.out[k].used AS used FROM done d, unnest(range(1, len(d.out) + 1)) AS u(k)),
long_words AS MATERIALIZED (
  SELECT review_id, i, j, w[j] AS w, CAST({tokens('w[j]')} AS INTEGER) AS cost
  FROM (SELECT review_id, i, list_filter(string_split_regex(s, '{WS}+'), lambda x: x <> '') AS w FROM sent WHERE t > 500), unnest(range(1, len(w) + 1)) AS u(j)
),
packing AS (
  SELECT review_id, i, CAST(1 AS BIGINT) AS j, 0 AS p, cost AS used FROM long_words WHERE j = 1
  UNION ALL
  SELECT k.review_id, k.i, k.j + 1, CASE WHEN k.used + w.cost > 500 THEN k.p + 1 ELSE k.p END, CAST(CASE WHEN k.used + w.cost > 500 THEN w.cost ELSE k.used + w.cost END AS INTEGER)
  FROM packing k JOIN long_words w ON w.review_id = k.review_id AND w.i = k.i AND w.j = k.j + 1
),
pieces AS (
  SELECT k.review_id, k.i, k.p, string_agg(w.w, ' ' ORDER BY k.j) AS text
  FROM packing k JOIN long_words w ON w.review_id = k.review_id AND w.i = k.i AND w.j = k.j GROUP BY ALL
),
chunk_rows AS (
  SELECT review_id, CAST(0 AS BIGINT) AS k, 0 AS p, text, token_count AS tokens, CAST(len(l) AS INTEGER) AS sentences FROM parted WHERE token_count <= 500
  UNION ALL
  SELECT s.review_id, s.k, 0, array_to_string(d.l[s.a:s.b], ' '), s.used, CAST(s.b - s.a + 1 AS INTEGER)
  FROM spans s JOIN parted d ON d.review_id = s.review_id WHERE s.used >= 0
  UNION ALL
  SELECT s.review_id, s.k, p.p, p.text, CAST({tokens('p.text')} AS INTEGER), 1
  FROM spans s JOIN pieces p ON p.review_id = s.review_id AND p.i = s.a WHERE s.used < 0
),
chunks AS MATERIALIZED (
  SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY k, p) - 1 AS INTEGER) AS chunk_id, text, tokens, sentences FROM chunk_rows
),
chunk_stats AS MATERIALIZED (
  SELECT review_id, CAST(count(*) AS INTEGER) AS chunk_count, round_even(CAST(sum(tokens) AS DOUBLE) / count(*) * 10, 0) / 10 AS avg_chunk_tokens,
         min(tokens) AS min_chunk_tokens, max(tokens) AS max_chunk_tokens,
         CASE WHEN count(*) = 1 THEN CASE WHEN max(tokens) < 100 THEN 'too_short' WHEN max(tokens) > 800 THEN 'too_long' ELSE 'optimal' END
              ELSE CASE WHEN avg(tokens) < 200 THEN 'too_short' WHEN avg(tokens) > 600 THEN 'too_long' ELSE 'optimal' END END AS chunk_quality_flag
  FROM chunks GROUP BY review_id
)"""


#: Rows whose text is equal to another's or shares 0.8 of its trigrams, with the least review_id of their component.
VERIFIED = """
texts_of AS MATERIALIZED (SELECT text, min(review_id) AS id, count(*) AS copies, lower(text) AS t FROM silver GROUP BY text),
grams AS MATERIALIZED (SELECT DISTINCT id, substring(t, CAST(i AS INTEGER), 3) AS g FROM texts_of, unnest(range(1, length(t) - 1)) AS u(i) WHERE length(t) >= 3),
gram_counts AS MATERIALIZED (SELECT id, count(*) AS n FROM grams GROUP BY id),
both_have AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
near AS MATERIALIZED (SELECT a, b FROM both_have JOIN gram_counts na ON na.id = a JOIN gram_counts nb ON nb.id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
near_both AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS id, a AS root FROM near_both UNION SELECT e.b, r.root FROM reach r JOIN near_both e ON e.a = r.id),
clusters AS MATERIALIZED (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
verified AS MATERIALIZED (
  SELECT s.review_id, coalesce(c.cluster, CASE WHEN t.copies > 1 THEN t.id END) AS cluster
  FROM silver s JOIN texts_of t ON t.text = s.text LEFT JOIN clusters c ON c.id = t.id
)"""


def pii(text="text"):
    return f"""list_filter([CASE WHEN regexp_matches({text}, '(?i)(?:{ADDRESS})') THEN 'address' END,
         CASE WHEN regexp_matches({text}, '{EMAIL}') THEN 'email' END, CASE WHEN regexp_matches({text}, '{PHONE}') THEN 'phone' END], lambda x: x IS NOT NULL)"""


def gold(too_short=30, unknown=0, duplicates="members", **clean):
    """CTEs up to gold, the scored layer."""
    dup = {
        "members": "count(*) OVER (PARTITION BY s.text) > 1",
        "keep_first": "min(s.review_id) OVER (PARTITION BY s.text) <> s.review_id",
        "none": "false",
        "jaccard": "v.cluster IS NOT NULL",
    }[duplicates]
    near, cluster, join = (", " + VERIFIED.strip(), ", v.cluster", "LEFT JOIN verified v ON v.review_id = s.review_id") if duplicates == "jaccard" else ("", "", "")
    return f"""WITH RECURSIVE {silver(**clean)}, {CHUNKS.strip()}{near}, marked AS (
  SELECT s.*{cluster}, c.chunk_count, c.avg_chunk_tokens, c.min_chunk_tokens, c.max_chunk_tokens, c.chunk_quality_flag, {dup} AS is_duplicate, {pii('s.text')} AS types
  FROM silver s JOIN chunk_stats c ON c.review_id = s.review_id {join}
), parts AS (
  SELECT *, len(types) > 0 AS has_pii, '[' || array_to_string(list_transform(types, lambda x: '"' || x || '"'), ', ') || ']' AS pii_types,
         CASE chunk_quality_flag WHEN 'optimal' THEN 100 WHEN 'too_short' THEN {too_short} WHEN 'too_long' THEN 0 WHEN 'empty' THEN 0 ELSE {unknown} END AS chunk_score,
         CASE WHEN is_duplicate THEN 0 ELSE 100 END AS duplicate_score, CASE WHEN len(types) > 0 THEN 0 ELSE 100 END AS pii_score
  FROM marked
), gold AS MATERIALIZED (
  SELECT *, (4 * chunk_score + 3 * duplicate_score + 3 * pii_score) / 10.0::DOUBLE AS index_readiness_score,
         4 * chunk_score + 3 * duplicate_score + 3 * pii_score >= 700 AS index_ready,
         CASE WHEN 4 * chunk_score + 3 * duplicate_score + 3 * pii_score >= 700 THEN 'index'
              WHEN 4 * chunk_score + 3 * duplicate_score + 3 * pii_score >= 500 THEN 'review' ELSE 'reject' END AS recommendation
  FROM parts
)
"""


GOLD = gold()


_MARK = r"[^\s\x0b\x{85}\p{Z}\p{L}\p{N}]"
_PIECE = "''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?" + _MARK + f"+|{WS}+"
#: Of a run of white space before a word, the last character is parted from the others first.
_PARTS = rf"string_split(regexp_replace(%s, '({WS})({WS}[^\s\x0b\x{{85}}\p{{Z}}])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_PIECES = f"flatten(list_transform({_PARTS}, lambda part: regexp_extract_all(part, '{_PIECE}')))"


def byte_pairs(path: str) -> str:
    """CTEs with the tokens n of every piece p that occurs in documents or in a word of them; merges go by rank, leftmost first, one a round."""
    return f"""ranks AS MATERIALIZED (SELECT from_base64(token) AS token, rank FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
words_of AS (SELECT DISTINCT unnest(string_split_regex(text, '{WS}+')) AS w FROM documents),
pieces_of AS MATERIALIZED (SELECT DISTINCT p FROM (SELECT unnest({_PIECES % "text"}) AS p FROM documents UNION ALL SELECT unnest({_PIECES % "w"}) FROM words_of UNION ALL SELECT unnest({_PIECES % "(' ' || w)"}) FROM words_of UNION ALL SELECT ' ')),
merging AS (
  SELECT p, list_transform(range(1, 2 * strlen(p) + 1, 2), lambda i: unhex(hex(encode(p))[i:i + 1])) AS t FROM pieces_of
  UNION ALL
  SELECT p, t[:i - 1] || [t[i] || t[i + 1]] || t[i + 2:] FROM (
    SELECT p, t, arg_min(i, (rank, i)) AS i FROM (SELECT p, t, i, t[i] || t[i + 1] AS token FROM merging, unnest(range(1, len(t))) AS u(i)) JOIN ranks USING (token) GROUP BY p, t)
),
piece_tokens AS MATERIALIZED (SELECT p, min(len(t)) AS n FROM merging GROUP BY p)"""


def byte_pair_count(c: str) -> str:
    return f"(SELECT coalesce(sum(n), 0) FROM (SELECT unnest({_PIECES % c}) AS p) JOIN piece_tokens USING (p))"


def with_byte_pairs(sql: str, path: str) -> str:
    """SQL that counts by the pattern, made to count byte pairs; packed words have a space behind them."""
    head, tail = TOKENS.split("%s")
    first, *rest = sql.split(head)
    out = [first]
    for part in rest:
        c, after = part.split(tail, 1)
        out.append(byte_pair_count("(w[j] || ' ')" if c == "w[j]" else c) + after)
    return "".join(out).replace("WITH RECURSIVE ", f"WITH RECURSIVE {byte_pairs(path)}, ", 1)
