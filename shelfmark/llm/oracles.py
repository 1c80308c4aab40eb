"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from . import pii, secrets

ORACLES: dict[str, str] = {}


# A key by its place: what follows a head runs to the next one at most, of which a dash stands for the beginning. (Only a
# header line that holds another head would run over it.)
_SP = r"[ \t\n\x0B\f\r]"
_GAP = rf"(?:{_SP}|\\[rn])+"
_HEAD = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_BODY = r"[A-Za-z0-9+/=\x20\t\n\x0B\f\r\\:,._]"
_LAST = r"[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{1,15}={0,2}"
_KEYS = f"""
km AS (SELECT doc_id, string_split_regex(t, '{_HEAD}') AS g, regexp_extract_all(t, '{_HEAD}', 0) AS h FROM d),
ke AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(g[:len(h)]) AS gap, unnest(h) AS hit, unnest(g[2:]) AS rest, len(h) AS n FROM km WHERE len(h) > 0),
kr AS (SELECT * EXCLUDE rest, rest || CASE WHEN i + 1 < n THEN '-' ELSE '' END AS rest FROM ke),
kp AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS head_end,
  regexp_extract(rest, '^(?:{_BODY}|-{{1,4}}{_BODY})*-----END [A-Z ]*PRIVATE KEY-----', 0) AS whole,
  regexp_extract(rest, '^(?:{_GAP}[A-Za-z-]{{4,}}: [^\\r\\n]*)*', 0) AS headers FROM kr),
kw AS (SELECT *, substring(rest, length(headers) + 1) AS r, regexp_extract(substring(rest, length(headers) + 1), '^(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})*', 0) AS ws FROM kp),
kv AS (SELECT *, CASE WHEN regexp_matches(substring(r, length(ws) + 1, 1), '[A-Za-z0-9+/=._-]')
    THEN regexp_replace(ws, '{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}}$', '') ELSE ws END AS v FROM kw),
keys AS (SELECT doc_id, head_end - length(hit) AS start, head_end + CASE WHEN whole <> '' THEN length(whole) WHEN v = '' THEN 0
    ELSE length(headers) + length(v) + length(regexp_extract(substring(r, length(v) + 1), '^({_LAST})[ \\t]*(?:\\r?\\n|\\\\n|$)', 1)) END AS stop FROM kv)"""


def _secret_kind(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
        string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS h,
        regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM d"""


ORACLES["op7_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{_KEYS},
m AS ({" UNION ALL ".join(_secret_kind(n, r) for n, r in enumerate(secrets.RULES) if r.kind != "private_key")}),
e AS (SELECT doc_id, rank, kind, least, unnest(range(len(h))) AS i, unnest(g[:len(h)]) AS gap, unnest(h) AS hit,
             unnest(v) AS val FROM m WHERE len(h) > 0),
p AS (SELECT doc_id, rank, kind, least, length(val) AS n, length(hit) AS w,
             sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM e
      UNION ALL SELECT doc_id, {next(n for n, r in enumerate(secrets.RULES) if r.kind == "private_key")}, 'private_key', 1, 1, stop - start, stop FROM keys),
s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
             count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || (stop - w)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - w, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || (stop - w)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - w, rank) AS spans
      FROM p WHERE n >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""

# Words are numbered per text; a window is ten consecutive numbers, or a whole shorter item.
ORACLES["op3_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
         lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS words FROM iw WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS words
  FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, n, s, words FROM dwin WHERE words IN (SELECT words FROM win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN win USING (words, n)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES["op2_ball_tree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Only pairs that share a shingle can be linked; reachability by a recursive closure.
ORACLES["op5_superminhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
         lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

# Gaps and matches alternate, so the lengths before a match give its place.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"regexp_full_match(hit, '(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(\.|$)){4}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """len(ds) BETWEEN 12 AND 19 AND list_sum(list_transform(list_reverse(ds),
        lambda c, i: CASE WHEN i % 2 = 1 THEN c ELSE 2 * c - CASE WHEN c > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(ds) BETWEEN 9 AND 15"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", """length(replace(hit, ' ', '')) BETWEEN 15 AND 34 AND
        list_reduce(list_transform(string_split(substring(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4), ''),
          lambda c: (CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT),
          lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, 0::BIGINT) = 1"""),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", """left(hit, 3) NOT IN ('000', '666') AND hit < '9' AND hit[5:6] <> '00' AND hit[8:11] <> '0000'"""),
}


def _pii_kind(rank: int, kind: str) -> str:
    pattern, valid = _PII[kind]
    known = next(k for k in pii.KINDS if k.name == kind)
    near = f"regexp_matches(around, '{known.near}')"
    score = f"least(1.0, greatest(0.0, {known.score} + {pii.RAISED} * {near}::INT - {pii.LOWERED} * regexp_matches(around, '{pii.OTHER_NUMBERS}')::INT))"
    return f"""
k{rank}m AS (SELECT doc_id, t, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS h FROM d),
k{rank}e AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(g[:len(h)]) AS gap, unnest(h) AS hit FROM k{rank}m WHERE len(h) > 0),
k{rank}p AS (SELECT doc_id, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop,
  list_transform(regexp_extract_all(hit, '[0-9]'), lambda c: c::INT) AS ds FROM k{rank}e),
k{rank}s AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, stop - length(hit) AS start, stop, translate(
    substring(t, greatest(1, stop - length(hit) - {pii.BEFORE} + 1), least({pii.BEFORE}, stop - length(hit))) || chr(10) || substring(t, stop + 1, {pii.AFTER}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS around
  FROM k{rank}p JOIN d USING (doc_id) WHERE {valid}),
k{rank} AS (SELECT doc_id, rank, kind, start, stop FROM k{rank}s WHERE rank < {len(pii.BASE)} OR round({score}, 2) >= {pii.LEAST})"""


ORACLES["op11_pii"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_pii_kind(n, k.name) for n, k in enumerate(pii.KINDS))},
p AS ({" UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(pii.KINDS)))}),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {n}) AS n_{k.name}" for n, k in enumerate(pii.BASE))},
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(pii.BASE)}) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_ranked_search"] = f"""
WITH dt AS (SELECT doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS l FROM dt WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM dt) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, st),
it AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
      FROM it JOIN tf USING (t) JOIN wt USING (t), st GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

# Where a row is removed follows from the places of the filters it fails.
ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END ||
        CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END ||
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
e AS (SELECT part, filter_order, step, substring(filter_order, step, 1) AS filter, n, g, x, contains(fails, substring(filter_order, step, 1)) AS failing,
        fails = substring(filter_order, step, 1) AS alone,
        CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda y: instr(filter_order, y))) END AS place FROM c, s),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN place > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN failing AND place < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN place = step THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN place = step THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
