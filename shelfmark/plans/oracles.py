"""SQL twins of the registered queries, for a DuckDB that sees the same tables.

They are written independently of the operators: where an operator folds or multiplies
matrices, the SQL unnests, joins and ranks.
"""

from __future__ import annotations

from ..operators.ranking import PROMPT

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
BLANK = r"NOT regexp_matches({0}, '\S')"


def chunk_rows(variant: str, drafts: str, alias: str = "chunks") -> str:
    """A CTE of numbered chunks from a list of ``{'c': text, ...}`` drafts per document."""
    return f"""
drafts_{alias} AS (
  SELECT doc_id, lang, source, text AS doc_text,
         list_filter({drafts}, lambda d: d.c <> '') AS ds
  FROM documents WHERE regexp_matches(text, '\\S')),
{alias} AS (
  SELECT sha256('{variant}|' || doc_id || '|' || (i - 1)) AS chunk_id, doc_id, (i - 1)::BIGINT AS chunk_index,
         d.c AS content, d AS draft, lang, source, doc_text
  FROM (SELECT doc_id, lang, source, doc_text, unnest(ds) AS d, generate_subscripts(ds, 1) AS i
        FROM drafts_{alias}))"""


FIXED_DRAFTS = f"""list_transform(range(0, length(text), 384), lambda s:
  {{'c': trim(substring(text, s + 1, 512), {WS}), 's': s, 'e': least(s + 512, length(text))}})"""
FIXED = chunk_rows("fixed_512_128", FIXED_DRAFTS)

TOKENS = f"list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda t: t <> '')"
# The token list is bound by a subquery, since a lambda would split the text for every window.
TOKEN = f"""
toks AS (SELECT doc_id, lang, source, text, {TOKENS} AS t FROM documents WHERE regexp_matches(text, '\\S')),
tokdrafts AS (
  SELECT doc_id, lang, source, text, list_transform(range(0, len(t), 112), lambda s:
    {{'c': array_to_string(list_slice(t, s + 1, s + 128), ' '), 'n': least(128, len(t) - s)}}) AS ds FROM toks),
tchunks AS (
  SELECT sha256('token_512_64|' || doc_id || '|' || (i - 1)) AS chunk_id, doc_id, (i - 1)::BIGINT AS chunk_index,
         d.c AS content, d AS draft, lang, source
  FROM (SELECT doc_id, lang, source, unnest(ds) AS d, generate_subscripts(ds, 1) AS i FROM tokdrafts))"""


def recursive_ctes(size: int, overlap: int) -> str:
    """One unnest, fold and regroup per separator; pieces keep their order by a path."""
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "' '"]
    out = ["r0 AS (SELECT doc_id, lang, source, [0]::BIGINT[] AS path, text AS p FROM documents WHERE regexp_matches(text, '\\S'))"]
    for i, sep in enumerate(seps):
        out.append(f"""r{i + 1} AS (
  SELECT doc_id, lang, source, path, p FROM r{i} WHERE length(p) <= {size}
  UNION ALL
  SELECT doc_id, lang, source, list_append(path, generate_subscripts(ps, 1)), unnest(ps)
  FROM (SELECT doc_id, lang, source, path, CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, f.cur) END AS ps
        FROM (SELECT doc_id, lang, source, path, list_reduce(
            list_transform(string_split(p, {sep}), lambda q: {{'p': q, 'cur': '', 'out': []::VARCHAR[]}}),
            lambda a, x: CASE
              WHEN length(a.cur) + length(x.p) + CASE WHEN a.cur = '' THEN 0 ELSE length({sep}) END <= {size}
                THEN {{'p': '', 'cur': CASE WHEN a.cur = '' THEN x.p ELSE a.cur || {sep} || x.p END, 'out': a.out}}
              WHEN length(x.p) > {size}
                THEN {{'p': '', 'cur': '', 'out': list_append(CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END, x.p)}}
              ELSE {{'p': '', 'cur': x.p, 'out': list_append(a.out, a.cur)}} END,
            {{'p': '', 'cur': '', 'out': []::VARCHAR[]}}) AS f FROM r{i} WHERE length(p) > {size})))""")
    out.append(f"""r7 AS (
  SELECT doc_id, lang, source, path, p FROM r6 WHERE length(p) <= {size}
  UNION ALL
  SELECT doc_id, lang, source, list_append(path, s), substring(p, s + 1, {size})
  FROM (SELECT *, unnest(range(0, length(p), {size - overlap})) AS s FROM r6 WHERE length(p) > {size}))""")
    out.append(f"""rtrimmed AS (
  SELECT doc_id, lang, source, trim(p, {WS}) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn
  FROM r7 WHERE trim(p, {WS}) <> ''),
rlap AS (
  SELECT doc_id, lang, source, rn, trim(coalesce(right(lag(c) OVER (PARTITION BY doc_id ORDER BY rn), {overlap}) || ' ', '') || c, {WS}) AS content
  FROM rtrimmed),
rchunks AS (
  SELECT doc_id, lang, source, content, (row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1)::BIGINT AS chunk_index
  FROM rlap WHERE content <> '')""")
    return ",\n".join(out)


RECURSIVE = recursive_ctes(512, 64)


BUCKETS = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: (('0x' || left(md5(t), 8))::BIGINT % 64))"


def embedded(source: str, key: str, text: str, name: str) -> str:
    """A CTE ``name(key, v)`` of hashed token counts, empty buckets included."""
    return f"""
{name}_b AS (SELECT {key} AS id, unnest({BUCKETS.format(text)}) AS b FROM {source}),
{name}_n AS (SELECT id, b, count(*) AS n FROM {name}_b GROUP BY ALL),
{name}_h AS (SELECT id, map_from_entries(list({{'k': b, 'v': n}})) AS m FROM {name}_n GROUP BY id),
{name} AS (SELECT s.{key} AS id, list_transform(range(0, 64), lambda b: coalesce(h.m[b], 0)::DOUBLE) AS v
           FROM {source} s LEFT JOIN {name}_h h ON h.id = s.{key})"""


def cos(a: str, b: str) -> str:
    return f"""round(CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0
      ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END, 9)"""


TEXT_KNN = FIXED + "," + embedded("chunks", "chunk_id", "content", "cv") + "," + embedded(
    "benchmark", "item_id", "text", "qv") + f""",
pairs AS (SELECT q.id AS query_id, c.id AS chunk_id, {cos('q.v', 'c.v')} AS score FROM qv q, cv c)"""


def deduped(k: int, fetch: int, source: str = "pairs", prefix: str = "") -> str:
    """CTE ``hits``: over-fetch, one hit per normalised text, then the first k."""
    return f"""
{prefix}fetched AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}
  QUALIFY rank <= {fetch}),
{prefix}normed AS (
  SELECT f.query_id, f.chunk_id, f.score, f.rank, c.content, c.lang, c.doc_id,
         lower(regexp_replace(trim(c.content, {WS}), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS norm
  FROM {prefix}fetched f JOIN chunks c USING (chunk_id)),
{prefix}hits AS (
  SELECT query_id, chunk_id, score, content, lang, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
  FROM (SELECT * FROM {prefix}normed QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank) = 1)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {k})"""


def lexical(candidates: str) -> str:
    """CTEs up to ``scored(query_id, chunk_id, bm25)`` over a candidate table."""
    return f"""
qterms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+')) AS term FROM benchmark),
ctok AS (SELECT query_id, chunk_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}'']+') AS toks FROM {candidates}),
clen AS (SELECT query_id, chunk_id, len(toks) AS dl, count(*) OVER (PARTITION BY query_id) AS n,
                avg(len(toks)) OVER (PARTITION BY query_id) AS adl FROM ctok),
cterm AS (SELECT query_id, chunk_id, term, count(*) AS tf
          FROM (SELECT query_id, chunk_id, unnest(toks) AS term FROM ctok) GROUP BY ALL),
cdf AS (SELECT query_id, term, count(*) AS df FROM cterm GROUP BY ALL),
scored AS (
  SELECT l.query_id, l.chunk_id, round(coalesce(sum(
    ln(1 + (l.n - d.df + 0.5) / (d.df + 0.5)) * (x.tf * 2.2 / (x.tf + 1.2 * (0.25 + 0.75 * (l.dl / l.adl))) + 0.5)), 0), 9) AS bm25
  FROM clen l LEFT JOIN (SELECT c.* FROM cterm c JOIN qterms q USING (query_id, term)) x USING (query_id, chunk_id)
  LEFT JOIN cdf d ON d.query_id = x.query_id AND d.term = x.term
  GROUP BY l.query_id, l.chunk_id)"""


VEC = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
VEC_PAIRS = VEC + f""",
vp AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, {cos('q.v', 'c.v')} AS score FROM emb q, emb c)"""
VEC_TOP = VEC_PAIRS + """,
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vp QUALIFY rank <= 10)"""

LINES = f"""
raw_lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
lines AS (SELECT doc_id, trim(l, {WS}) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
          FROM raw_lines WHERE trim(l, {WS}) <> ''),
marked AS (SELECT *, length(l) <= 80 AND len(regexp_split_to_array(l, '[ \\t\\n\\v\\f\\r]+')) <= 12
                     AND NOT regexp_matches(l, '[.,;:?!]$') AS is_head FROM lines),
sectioned AS (SELECT doc_id, i, l, is_head,
   coalesce(last_value(CASE WHEN is_head THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS section FROM marked)"""

URLS = r"""
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme,
   lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
   regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
   regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, host || regexp_replace(path, '(.)/$', '\1') AS url_key, scheme || '://' || host AS origin FROM u)"""

NAV = r"""
hrefs AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
resolved AS (SELECT page_id, pos, CASE WHEN href LIKE 'http%' THEN href
   ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') || href END AS link, href FROM hrefs)"""

ORPHANS = FIXED + """,
owned AS (SELECT chunk_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN '' ELSE l.doc_id::VARCHAR END AS doc_id
          FROM chunks c LEFT JOIN labels l ON c.doc_id = l.doc_id)"""

JOBS = """
jobs AS (SELECT user_id AS batch, event_id AS doc_id, floor(value)::BIGINT AS chunk_count, props AS message,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' AND value > 250 THEN 'RUNNING' ELSE 'COMPLETED' END AS state
  FROM events)"""

JSON_LINES = """
jraw AS (SELECT doc_id, lang, source, n_chars, string_split(text, chr(10)) AS ls FROM documents),
jblocks AS (
  SELECT doc_id, 0 AS a, 0 AS b, '{"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}' AS content, '' AS section, '$' AS json_path FROM jraw
  UNION ALL
  SELECT doc_id, 1, i, unnest(ls), 'lines', '$.lines[' || i || ']' FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM jraw) WHERE false
  UNION ALL
  SELECT doc_id, 1, i, l, 'lines', '$.lines[' || i || ']' FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM jraw)
  UNION ALL
  SELECT doc_id, 2, 0, '{"size":' || n_chars || '}', 'stats', '$.stats' FROM jraw
  UNION ALL
  SELECT doc_id, 3, 0, '{"last":' || n_chars || '}', '', '$' FROM jraw),
jnum AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::BIGINT AS block_idx FROM jblocks)"""

O: dict[str, str] = {}

O["read_documents"] = f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN left(text, 40) ELSE 'Untitled document' END AS title, NULL::VARCHAR AS reject_reason
FROM documents WHERE regexp_matches(text, '\\S')
UNION ALL SELECT doc_id, NULL, 'content is blank and no bytes were sent' FROM documents WHERE {BLANK.format('text')}"""

O["flatten_catalog"] = """
SELECT p_brand AS provider_id, p_partkey::VARCHAR AS model_id,
  CASE WHEN p_size > 25 THEN p_name ELSE p_partkey::VARCHAR END AS name, p_size::BIGINT AS context_limit, 0::BIGINT AS output_limit,
  false AS reasoning, false AS tool_call, false AS structured_output, p_retailprice AS cost_input, 0.0::DOUBLE AS cost_output,
  NULL::VARCHAR AS status, 'https://' || p_brand AS base_url, 'KEY' AS api_key_env FROM part"""

O["read_sitemaps"] = f"""WITH {URLS}
SELECT url, false AS is_index, 0::BIGINT AS pos, url AS loc FROM k WHERE url NOT LIKE '%&%'
UNION ALL SELECT url, false, 1, origin || '/about' FROM k WHERE url NOT LIKE '%&%'"""

O["read_robots"] = f"""WITH {URLS}
SELECT host || '#' || page_id AS host, 'disallow' AS kind, 0::BIGINT AS pos, '/' || string_split(url, '/')[4] || '/' AS value FROM k
UNION ALL SELECT host || '#' || page_id, 'sitemap', 1, origin || '/map.xml' FROM k"""

O["upsert_chunks"] = f"""WITH {FIXED}
SELECT chunk_id, doc_id, chunk_index, CASE WHEN lang = 'fr' THEN upper(content) ELSE content END AS content FROM chunks
UNION ALL SELECT chunk_id || '-new', doc_id, chunk_index, upper(content) FROM chunks WHERE lang = 'fr'"""

O["delete_document"] = f"""WITH {FIXED}
SELECT chunk_id, doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""

O["delete_orphans"] = f"""WITH {FIXED} SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)"""

O["variant_store"] = f"""WITH {FIXED}, kept AS (
  SELECT * FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT m.module, 'fixed_512_128' AS variant, count(*) AS chunks, count(DISTINCT doc_id) AS documents
FROM kept, (VALUES ('basic'), ('advanced')) m(module) GROUP BY m.module"""

O["detect_format"] = """
SELECT page_id, CASE WHEN regexp_matches(url, '^[^?#]*\\.html?($|[?#])') THEN 'HTML'
  WHEN contains(url, 'utm_') THEN 'MARKDOWN' ELSE 'UNKNOWN' END AS format FROM pages"""

O["plain_blocks"] = "SELECT doc_id, 0::BIGINT AS block_idx, 'PARAGRAPH' AS type, md5(text) AS digest FROM documents"

O["json_blocks"] = """SELECT event_id AS doc_id, 0::BIGINT AS block_idx, 'JSON_OBJECT' AS type,
  '{"k":' || (props::JSON ->> '$.k') || '}' AS content, '$' AS json_path FROM events"""

O["json_document_blocks"] = f"""WITH {JSON_LINES}
SELECT doc_id, block_idx, 'JSON_OBJECT' AS type, content, section, json_path FROM jnum"""

O["markdown_blocks"] = f"""WITH b AS (
  SELECT conv_id, turn, 0 AS i, 'HEADING' AS type, 'Turn' AS content, 'Turn' AS section FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'HEADING', role, 'Turn > ' || role FROM conversations
  UNION ALL SELECT conv_id, turn, 2, 'PARAGRAPH', array_to_string(list_transform(string_split(trim(text, {WS}), chr(10)), lambda l: trim(l, {WS})), chr(10)),
    'Turn > ' || role FROM conversations WHERE regexp_matches(text, '\\S'))
SELECT conv_id AS doc_id, turn, i::BIGINT AS block_idx, type, content, section FROM b"""

PAGE = r"""
praw AS (SELECT page_id, url, 0 AS a, 0 AS b, 'TITLE' AS type, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS x FROM pages
  UNION ALL SELECT page_id, url, 1, 0, 'PARAGRAPH', regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') FROM pages
  UNION ALL SELECT page_id, url, 2, 0, 'HEADING', regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') FROM pages
  UNION ALL SELECT page_id, url, 3, i, 'PARAGRAPH', split_part(p, '</p>', 1) FROM (
    SELECT page_id, url, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT page_id, url, string_split(split_part(split_part(html, '</h1>', 2), '</article>', 1), '<p>')[2:] AS ps FROM pages))),
ptext AS (SELECT page_id, url, a, b, type, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '[ \t\n\f\r]+', ' ', 'g')) AS content FROM praw),
pblocks AS (SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY a, b) - 1)::BIGINT AS block_idx, type, content,
   CASE WHEN a >= 2 THEN coalesce(max(CASE WHEN a = 2 THEN content END) OVER (PARTITION BY page_id), '') ELSE '' END AS section
   FROM ptext WHERE content <> '')"""
O["page_blocks"] = f"WITH {PAGE} SELECT page_id AS doc_id, block_idx, type, content, section FROM pblocks"
O["page_to_document"] = f"""WITH {PAGE}
SELECT page_id AS doc_id, 'HTML' AS source_type, url AS source, max(content) FILTER (type = 'TITLE') AS title, count(*) AS blocks FROM pblocks GROUP BY page_id, url"""

ENTITIES = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"

# The same blocks with their place in the page, and the footer, which only the crawler skips.
HTML_ALL = f"""{PAGE},
foot AS (SELECT page_id, trim(regexp_replace({ENTITIES.format("regexp_replace(regexp_extract(html, '<footer>(.*?)</footer>', 1, 's'), '<[^>]*>', '', 'g')")},
   '[ \\t\\n\\f\\r]+', ' ', 'g')) AS content FROM pages),
kids AS (SELECT page_id, count(*) AS n FROM praw WHERE a = 3 GROUP BY page_id),
al AS (SELECT p.page_id, p.a, p.b, p.type, p.content, CASE WHEN a >= 2 THEN (SELECT h.content FROM ptext h WHERE h.page_id = p.page_id AND h.a = 2) ELSE '' END AS section,
   CASE a WHEN 0 THEN NULL WHEN 1 THEN 'html > body > div.ad' WHEN 2 THEN 'html > body > article > h1'
     ELSE 'html > body > article > p' || CASE WHEN kids.n > 1 THEN ':nth-child(' || (b + 1) || ')' ELSE '' END END AS dom_path
   FROM ptext p LEFT JOIN kids ON kids.page_id = p.page_id WHERE content <> ''
   UNION ALL SELECT page_id, 4, 0, 'PARAGRAPH', content, '', 'html > body > footer' FROM foot WHERE content <> '')"""
O["html_blocks"] = f"""WITH {HTML_ALL}
SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY a, b) - 1)::BIGINT AS block_idx, type, content, section,
  NULL::INTEGER AS page, dom_path FROM al"""

O["dispatch_parse"] = f"""WITH {HTML_ALL}, b AS (
  SELECT 'page-' || page_id AS doc_id, 'HTML' AS source_type, length(content) AS n FROM al
  UNION ALL SELECT 'event-' || event_id, 'JSON', length('{{"k":' || (props::JSON ->> '$.k') || '}}') FROM events
  UNION ALL SELECT 'turn-' || conv_id || '-' || turn, 'MARKDOWN', length(role) FROM conversations
  UNION ALL SELECT 'turn-' || conv_id || '-' || turn, 'MARKDOWN', length(array_to_string(list_transform(string_split(trim(text, {WS}), chr(10)), lambda l: trim(l, {WS})), chr(10)))
    FROM conversations WHERE regexp_matches(text, '\\S')
  UNION ALL SELECT 'doc-' || doc_id, 'TEXT', length(text) FROM documents WHERE regexp_matches(text, '\\S'))
SELECT doc_id, source_type, count(*) AS blocks, (sum(n) + 2 * (count(*) - 1))::BIGINT AS chars FROM b GROUP BY doc_id, source_type"""

O["read_pages"] = f"""WITH {PAGE}, {NAV},
body AS (SELECT page_id, trim(regexp_replace({ENTITIES.format("regexp_replace(regexp_replace(regexp_replace(html, '<style>.*?</style>|<script>.*?</script>|<!--.*?-->', '', 'gs'), '</?(p|h1|div|article|nav|ul|li|footer|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')")},
   '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t FROM pages)
SELECT p.page_id, p.url, (SELECT max(content) FROM pblocks b WHERE b.page_id = p.page_id AND b.type = 'TITLE') AS title,
  length(body.t)::BIGINT AS text_chars, (SELECT count(*) FROM resolved r WHERE r.page_id = p.page_id) AS links,
  (SELECT count(DISTINCT link) FROM resolved r WHERE r.page_id = p.page_id) AS nav_links,
  (SELECT count(*) FROM pblocks b WHERE b.page_id = p.page_id) AS blocks
FROM pages p JOIN body ON body.page_id = p.page_id"""

O["heuristic_headings"] = f"""WITH {LINES}
SELECT doc_id, (i - 1)::BIGINT AS block_idx, CASE WHEN is_head THEN 'HEADING' ELSE 'PARAGRAPH' END AS type, l AS content, section
FROM sectioned"""

O["page_links"] = f"WITH {NAV} SELECT page_id, pos::BIGINT AS pos, link FROM resolved"

O["nav_links"] = r"""WITH navs AS (SELECT page_id, url, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS html FROM pages),
hrefs AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS i
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM navs)),
firsts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link, min(i) AS i FROM hrefs GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS pos, link FROM firsts"""

O["reject_empty"] = r"""SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(text, '[A-Za-z0-9]', '', 'g'), '\S') THEN 'ok'
  ELSE 'No text could be extracted from document ' || doc_id END AS state FROM documents"""

O["chunk_fixed"] = f"""WITH {FIXED}
SELECT chunk_id, doc_id, chunk_index, content, draft.s::BIGINT AS start_pos, draft.e::BIGINT AS end_pos FROM chunks"""

O["chunk_token"] = f"""WITH {TOKEN}
SELECT chunk_id, doc_id, chunk_index, content, draft.n::BIGINT AS token_count FROM tchunks"""

O["chunk_recursive"] = f"""WITH {RECURSIVE}
SELECT sha256('recursive_512_64|' || doc_id || '|' || chunk_index) AS chunk_id, doc_id, chunk_index, content FROM rchunks"""

# Sentences: a boundary is marked by a control character, as there is no lookbehind.
SENTS = f"""
sraw AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\v\\f\\r]+|\\n[ \\t\\n\\v\\f\\r]*\\n', '\\1' || chr(1), 'g'), chr(1)) AS ss
         FROM documents WHERE length(text) > 512),
sflat AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sraw),
sents AS (SELECT doc_id, trim(s, {WS}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i,
                 doc_id || '-' || i AS sid FROM sflat WHERE trim(s, {WS}) <> '')"""

SEMANTIC = SENTS + "," + embedded("sents", "sid", "s", "sv") + f""",
sord AS (SELECT s.doc_id, s.i, s.s, v.v, lag(v.v) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS pv FROM sents s JOIN sv v ON v.id = s.sid),
sdist AS (SELECT doc_id, i, s, CASE WHEN pv IS NULL THEN NULL WHEN list_inner_product(v, v) = 0 OR list_inner_product(pv, pv) = 0 THEN 1::FLOAT
   ELSE (1::FLOAT - (list_inner_product(v, pv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(pv, pv))))::FLOAT)::FLOAT END AS d FROM sord),
scut AS (SELECT doc_id, quantile_disc(d, 0.95) AS cut, (max(d) - min(d))::FLOAT > 1e-6::FLOAT AS varied FROM sdist WHERE d IS NOT NULL GROUP BY doc_id),
sitems AS (SELECT doc_id, list({{'s': s, 'b': coalesce(varied AND d >= cut, false), 'cur': '', 'out': []::VARCHAR[]}} ORDER BY i) AS items
           FROM sdist LEFT JOIN scut USING (doc_id) GROUP BY doc_id),
sfold AS (SELECT doc_id, list_reduce(items, lambda a, x: CASE
    WHEN length(x.s) > 512 THEN {{'s': '', 'b': false, 'cur': '', 'out': list_concat(
        CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, a.cur) END,
        list_transform(range(0, length(x.s), 512), lambda p: substring(x.s, p + 1, 512)))}}
    WHEN a.cur <> '' AND (x.b OR length(a.cur) + 1 + length(x.s) > 512)
      THEN {{'s': '', 'b': false, 'cur': x.s, 'out': list_append(a.out, a.cur)}}
    ELSE {{'s': '', 'b': false, 'cur': CASE WHEN a.cur = '' THEN x.s ELSE a.cur || ' ' || x.s END, 'out': a.out}} END,
    {{'s': '', 'b': false, 'cur': '', 'out': []::VARCHAR[]}}) AS f FROM sitems),
spieces AS (SELECT doc_id, CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, f.cur) END AS ps FROM sfold
            UNION ALL SELECT doc_id, [text] FROM documents WHERE length(text) <= 512 AND regexp_matches(text, '\\S')),
sexp AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM spieces),
slap AS (SELECT doc_id, i, trim(coalesce(right(lag(p) OVER (PARTITION BY doc_id ORDER BY i), 64) || ' ', '') || p, {WS}) AS content FROM sexp),
schunks AS (SELECT doc_id, content, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk_index FROM slap WHERE content <> '')"""

O["chunk_semantic"] = f"""WITH {SEMANTIC}
SELECT sha256('semantic_512_64|' || doc_id || '|' || chunk_index) AS chunk_id, doc_id, chunk_index, content FROM schunks"""

O["densify"] = f"WITH {LINES} SELECT doc_id, (i - 1)::BIGINT AS chunk_index, l AS content FROM lines"

O["overlap_prefix"] = f"""WITH {LINES}
SELECT doc_id, (i - 1)::BIGINT AS pos, coalesce(right(lag(l) OVER (PARTITION BY doc_id ORDER BY i), 24) || ' ', '') || l AS content FROM raw_lines"""

O["group_sections"] = f"""WITH {LINES},
items AS (SELECT doc_id, list({{'l': l, 'h': is_head, 'sec': section, 'cur': '', 'cs': '', 'out': []::STRUCT(t VARCHAR, c VARCHAR)[]}} ORDER BY i) AS xs
          FROM sectioned GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(xs, lambda a, x: CASE
   WHEN x.h THEN {{'l': '', 'h': false, 'sec': '', 'cur': '', 'cs': x.sec,
      'out': CASE WHEN a.cur = '' THEN a.out ELSE list_append(a.out, {{'t': a.cur, 'c': a.cs}}) END}}
   WHEN length(CASE WHEN a.cur = '' THEN x.l ELSE a.cur || chr(10) || chr(10) || x.l END) > 512
      THEN {{'l': '', 'h': false, 'sec': '', 'cur': '', 'cs': x.sec,
      'out': list_append(a.out, {{'t': CASE WHEN a.cur = '' THEN x.l ELSE a.cur || chr(10) || chr(10) || x.l END, 'c': x.sec}})}}
   ELSE {{'l': '', 'h': false, 'sec': '', 'cur': CASE WHEN a.cur = '' THEN x.l ELSE a.cur || chr(10) || chr(10) || x.l END, 'cs': x.sec, 'out': a.out}} END,
   {{'l': '', 'h': false, 'sec': '', 'cur': '', 'cs': '', 'out': []::STRUCT(t VARCHAR, c VARCHAR)[]}}) AS f FROM items),
gs AS (SELECT doc_id, CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, {{'t': f.cur, 'c': f.cs}}) END AS g FROM folded)
SELECT doc_id, (i - 1)::BIGINT AS group_idx, x.t AS text, 'PARAGRAPH' AS content_type, x.c AS context
FROM (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM gs)"""

O["group_json"] = f"""WITH {JSON_LINES},
items AS (SELECT doc_id, list({{'l': content, 'sec': section, 'cur': '', 'cs': '', 'n': 0, 'out': []::STRUCT(t VARCHAR, c VARCHAR)[]}} ORDER BY block_idx) AS xs
          FROM jnum WHERE regexp_matches(content, '\\S') GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(xs, lambda a, x: CASE
   WHEN a.n > 0 AND (a.n >= 5 OR a.cs <> x.sec OR length(a.cur) + length(x.l) > 512)
     THEN {{'l': '', 'sec': '', 'cur': x.l, 'cs': x.sec, 'n': 1, 'out': list_append(a.out, {{'t': a.cur, 'c': a.cs}})}}
   ELSE {{'l': '', 'sec': '', 'cur': CASE WHEN a.n = 0 THEN x.l ELSE a.cur || chr(10) || chr(10) || x.l END, 'cs': x.sec, 'n': a.n + 1, 'out': a.out}} END,
   {{'l': '', 'sec': '', 'cur': '', 'cs': '', 'n': 0, 'out': []::STRUCT(t VARCHAR, c VARCHAR)[]}}) AS f FROM items),
gs AS (SELECT doc_id, CASE WHEN f.n = 0 THEN f.out ELSE list_append(f.out, {{'t': f.cur, 'c': f.cs}}) END AS g FROM folded)
SELECT doc_id, (i - 1)::BIGINT AS group_idx, x.t AS text, 'JSON_OBJECT' AS content_type, x.c AS context
FROM (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM gs)"""

O["chunk_variants"] = f"""WITH {FIXED}, {TOKEN}
SELECT 'fixed_512_128' AS variant, chunk_id, doc_id, chunk_index, md5(content) AS digest FROM chunks
UNION ALL SELECT 'token_512_64', chunk_id, doc_id, chunk_index, md5(content) FROM tchunks"""

O["compare_chunking"] = f"""WITH {FIXED}, {TOKEN}, {RECURSIVE}, {SEMANTIC},
n AS (SELECT count(*) AS documents FROM documents WHERE regexp_matches(text, '\\S')),
c AS (SELECT 'fixed_512_128' AS variant, (SELECT count(*) FROM chunks) AS chunks, 0 AS split_embeds
  UNION ALL SELECT 'token_512_64', (SELECT count(*) FROM tchunks), 0
  UNION ALL SELECT 'recursive_512_64', (SELECT count(*) FROM rchunks), 0
  UNION ALL SELECT 'semantic_512_64', (SELECT count(*) FROM schunks),
    (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM sents GROUP BY doc_id HAVING count(*) > 1))),
t AS (SELECT *, chunks + split_embeds AS ingest_embeds FROM c, n)
SELECT variant, documents, chunks, round(chunks / documents, 6) AS chunks_per_document, split_embeds::BIGINT AS split_embeds,
  ingest_embeds::BIGINT AS ingest_embeds,
  round(ingest_embeds / (SELECT ingest_embeds FROM t WHERE variant = 'recursive_512_64'), 6) AS ratio_to_baseline FROM t"""

O["embed"] = """WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
letters AS (SELECT unnest(range(0, 26)) AS dim)
SELECT doc_id, dim::BIGINT AS dim, (length(t) - length(replace(t, chr((97 + dim)::INTEGER), '')))::BIGINT AS value FROM l, letters"""

O["hashing_embedding_query"] = f"""WITH {FIXED}
SELECT chunk_id, b::BIGINT AS dim, count(*)::BIGINT AS value
FROM (SELECT chunk_id, unnest({BUCKETS.format('content')}) AS b FROM chunks) GROUP BY ALL"""

O["check_embeddings"] = "SELECT len(embedding)::BIGINT AS dimensions, count(*) AS total_chunks FROM embeddings GROUP BY 1"
O["vector_dims"] = O["check_embeddings"]

O["cosine_neighbours"] = f"""WITH {VEC}
SELECT a.vec_id, round({cos('a.v', 'b.v')}, 6) AS score FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1"""

O["knn"] = f"WITH {VEC_TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top"

O["ivf_full_probe"] = O["knn"]

O["knn_in_document"] = f"""WITH {VEC_PAIRS}
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY vp.score DESC, chunk_id) AS rank
FROM vp WHERE ql = cl QUALIFY rank <= 5"""

O["fetch_size"] = """SELECT p_partkey, (CASE WHEN k <= 0 THEN 0 WHEN k > 256 THEN k ELSE least(k * 4, 256) END)::BIGINT AS fetch
FROM (SELECT p_partkey, p_size * 7 - 20 AS k FROM part)"""

O["dedup_hits"] = f"""WITH d AS (SELECT lang AS query_id, doc_id AS chunk_id, doc_id + 1 AS rank,
   lower(regexp_replace(trim(lower(text), {WS}), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS norm FROM documents),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank) = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY f.rank) AS rank FROM f"""

O["search"] = f"WITH {TEXT_KNN}, {deduped(5, 20)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits"

O["metadata_filter"] = f"""WITH {TEXT_KNN}, {deduped(20, 80)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE lang = 'en'"""

O["bm25"] = f"""WITH {TEXT_KNN}, {deduped(20, 80)}, {lexical('hits')}
SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM scored"""

O["bm25_corpus"] = """
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+')) AS term FROM benchmark),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+') AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
        (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len / mean))) + 0.5)), 9) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""

O["rrf"] = f"""WITH {TEXT_KNN}, {deduped(20, 80)}, {lexical('hits')},
l AS (SELECT h.query_id, h.chunk_id, h.rank, row_number() OVER (PARTITION BY h.query_id ORDER BY s.bm25 DESC, h.rank) AS lexical_rank
      FROM hits h JOIN scored s USING (query_id, chunk_id))
SELECT query_id, chunk_id, lexical_rank, round(1.0 / (60 + rank) + 1.0 / (60 + lexical_rank), 9) AS rrf FROM l"""

HYBRID = f"""{TEXT_KNN}, {deduped(20, 80)},
matches AS (SELECT query_id, chunk_id, content, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS v,
                   count(*) OVER (PARTITION BY query_id) AS n FROM hits WHERE lang = 'en'), {lexical('matches')},
l AS (SELECT m.query_id, m.chunk_id, m.v, m.n, row_number() OVER (PARTITION BY m.query_id ORDER BY s.bm25 DESC, m.v) AS lr
      FROM matches m JOIN scored s USING (query_id, chunk_id)),
f AS (SELECT *, CASE WHEN n > 5 THEN round(1.0::DOUBLE / (60 + v) + 1.0::DOUBLE / (60 + lr), 12) ELSE 0 END AS w, n > 5 AS fused FROM l)"""
O["hybrid_search"] = f"""WITH {HYBRID}
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, v) AS rank, fused FROM f QUALIFY rank <= 5"""

O["search_with_keyword"] = f"""WITH {FIXED}, {embedded('chunks', 'chunk_id', 'content', 'cv')},
m AS (SELECT c.*, v.v FROM chunks c JOIN cv v ON v.id = c.chunk_id WHERE content ILIKE '%THE %'),
seed AS (SELECT v FROM m ORDER BY chunk_id LIMIT 1),
d AS (SELECT m.*, round(1 - {cos('m.v', 'seed.v')}, 9) AS distance FROM m, seed)
SELECT chunk_id, doc_id, chunk_index, left(content, 150) AS content_preview, round(distance, 6) AS distance
FROM (SELECT * FROM d ORDER BY distance, chunk_id LIMIT 5)"""

O["pairwise_distance"] = f"""WITH {VEC_PAIRS}
SELECT chunk_a, chunk_b, round(distance, 6) AS distance FROM (
  SELECT query_id AS chunk_a, chunk_id AS chunk_b, round(1 - score, 9) AS distance FROM vp WHERE query_id < chunk_id
  ORDER BY distance, chunk_a, chunk_b LIMIT 15)"""

PLAN = f"""
s0 AS (SELECT item_id AS query_id, [text] AS parts FROM benchmark WHERE regexp_matches(text, '\\S')),
""" + ",\n".join(
    f"s{i + 1} AS (SELECT query_id, flatten(list_transform(parts, lambda p: string_split(p, '{c}'))) AS parts FROM s{i})"
    for i, c in enumerate([" and ", " then ", " but ", "; ", ";", "?", "."])
) + f""",
sflatq AS (SELECT query_id, trim(unnest(parts), {WS}) AS subquery, generate_subscripts(parts, 1) AS i FROM s7),
sfirst AS (SELECT query_id, subquery, min(i) AS i FROM sflatq WHERE regexp_matches(subquery, '\\S') GROUP BY ALL),
plan AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::BIGINT AS step, subquery FROM sfirst)"""
O["plan_subqueries"] = f"WITH {PLAN} SELECT query_id, step, subquery FROM plan"

STEPS = f"""{FIXED}, {embedded('chunks', 'chunk_id', 'content', 'cv')}, {PLAN},
asked AS (SELECT query_id || ':' || step AS sid, query_id AS q, step, subquery FROM plan WHERE step IN (0, 1, 2)), {embedded('asked', 'sid', 'subquery', 'av')},
pairs AS (SELECT q.id AS query_id, c.id AS chunk_id, {cos('q.v', 'c.v')} AS score FROM av q, cv c), {deduped(3, 12)},
found AS (SELECT a.q AS query_id, a.step, h.chunk_id, h.score, h.rank FROM hits h JOIN asked a ON a.sid = h.query_id)"""
O["multi_step_search"] = f"""WITH {STEPS}
SELECT query_id, chunk_id, round(score, 6) AS score, rank, step FROM found QUALIFY step = min(step) OVER (PARTITION BY query_id)"""

O["merge_sources"] = f"""WITH {STEPS},
first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step, rank) = 1)
SELECT query_id, chunk_id, step, rank, row_number() OVER (PARTITION BY query_id ORDER BY step, rank) AS position FROM first"""

O["build_context"] = f"""WITH {TEXT_KNN}, {deduped(3, 12)},
j AS (SELECT query_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank) AS context, count(*) AS sources
      FROM hits WHERE score > 0.6 GROUP BY query_id),
c AS (SELECT b.item_id AS query_id, b.text, coalesce(j.context, '(no context retrieved)') AS context, coalesce(j.sources, 0) AS sources
      FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id)
SELECT query_id, context, sources, replace(replace('{PROMPT}', '%1$s', context), '%2$s', text) AS prompt FROM c"""

O["search_with_default_k"] = f"""WITH {VEC_PAIRS}
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY vp.score DESC, chunk_id) AS rank
FROM vp QUALIFY rank <= CASE WHEN ql < 5 THEN ql ELSE 5 END"""

O["list_documents"] = f"""WITH {FIXED}
SELECT doc_id, count(*) AS chunk_count, arg_min(chunk_id, chunk_index) AS chunk_id, arg_min(lang, chunk_index) AS lang FROM chunks GROUP BY doc_id"""

O["chunks_per_document"] = f"""WITH {FIXED}
SELECT doc_id, count(*) AS chunk_count, min(chunk_id) AS first_chunk_id, max(chunk_id) AS last_chunk_id FROM chunks GROUP BY doc_id"""

O["document_titles"] = f"""WITH {FIXED}
SELECT doc_id, count(*) AS chunk_count, arg_min(left(doc_text, 40), chunk_index) AS title, arg_min(source, chunk_index) AS source
FROM chunks GROUP BY doc_id"""

O["metadata_keys"] = "SELECT unnest(['source', 'lang', 'title', 'strategy', 'start', 'end']) AS metadata_key WHERE EXISTS (SELECT 1 FROM documents)"

O["orphan_chunks"] = f"WITH {ORPHANS} SELECT doc_id, count(*) AS orphans FROM owned WHERE coalesce(doc_id, '') = '' GROUP BY doc_id"

O["table_counts"] = f"""WITH {FIXED}
SELECT 'ingestion_jobs' AS source, count(*) AS rows FROM events UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'chunks', count(*) FROM chunks"""

O["count_by_document_having"] = f"""WITH {ORPHANS}
SELECT doc_id, count(*) AS chunk_count FROM owned GROUP BY doc_id HAVING doc_id IS DISTINCT FROM ''"""

O["percentile_nearest_rank"] = """SELECT event_type, quantile_disc(value, 0.05) AS p5, quantile_disc(value, 0.5) AS p50,
  quantile_disc(value, 0.95) AS p95, quantile_disc(value, 1.0) AS p100 FROM events GROUP BY event_type"""

O["batch_summary"] = f"""WITH {JOBS}, s AS (
  SELECT batch, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed,
    coalesce(sum(chunk_count) FILTER (state = 'COMPLETED'), 0)::BIGINT AS chunks, count(*) FILTER (state = 'RUNNING') AS open
  FROM jobs GROUP BY batch)
SELECT batch, completed, failed, chunks,
  batch || ': ' || completed || ' page(s) complete, ' || failed || ' failed, ' || chunks || ' chunk(s) total.' AS summary
FROM s WHERE open = 0 AND completed + failed > 0"""

O["batch_failures"] = f"WITH {JOBS} SELECT batch, ' - ' || doc_id || ': ' || message AS failure FROM jobs WHERE state = 'FAILED'"

O["documents_by_store"] = f"""WITH {FIXED}, {TOKEN},
l AS (SELECT 'basic' AS module, doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id
      UNION ALL SELECT 'advanced', doc_id, count(*) FROM tchunks GROUP BY doc_id),
w AS (SELECT *, max(length(chunk_count::VARCHAR)) OVER (PARTITION BY module) AS width FROM l)
SELECT module, doc_id, chunk_count, '(' || lpad(chunk_count::VARCHAR, width::INTEGER, ' ') || ' chunks) [' || doc_id || ']' AS line FROM w"""

O["bounded_top_k"] = f"""WITH {FIXED}
SELECT chunk_id, length(content) AS content_length, doc_id, chunk_index FROM chunks ORDER BY content_length DESC, chunk_id LIMIT 25"""

O["document_openings"] = f"""WITH {FIXED}
SELECT l.doc_id, l.quality, c.chunk_id, c.chunk_index FROM labels l
LEFT JOIN (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) <= 2) c ON c.doc_id = l.doc_id"""

O["pack_lines"] = f"""WITH {LINES},
items AS (SELECT doc_id, list({{'l': l, 'cur': '', 'on': false, 'out': []::VARCHAR[]}} ORDER BY i) AS xs FROM raw_lines GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(xs, lambda a, x: CASE
   WHEN NOT a.on THEN {{'l': '', 'cur': x.l, 'on': true, 'out': a.out}}
   WHEN length(a.cur) + 1 + length(x.l) > 512 THEN {{'l': '', 'cur': x.l, 'on': true, 'out': list_append(a.out, a.cur)}}
   ELSE {{'l': '', 'cur': a.cur || chr(10) || x.l, 'on': true, 'out': a.out}} END,
   {{'l': '', 'cur': '', 'on': false, 'out': []::VARCHAR[]}}) AS f FROM items),
ps AS (SELECT doc_id, list_append(f.out, f.cur) AS p FROM folded)
SELECT doc_id, (i - 1)::BIGINT AS piece_index, c AS content FROM (SELECT doc_id, unnest(p) AS c, generate_subscripts(p, 1) AS i FROM ps)"""

O["longest_chunks"] = f"""WITH {TOKEN}
SELECT chunk_id, length(content) AS content_length, doc_id, chunk_index FROM tchunks ORDER BY content_length DESC, chunk_id LIMIT 10"""

O["chunk_preview"] = f"""WITH {FIXED}
SELECT chunk_id, left(content, 120) AS content_preview, doc_id, chunk_index FROM chunks ORDER BY doc_id, chunk_index LIMIT 20"""

O["document_chunks"] = f"""WITH {FIXED}
SELECT chunk_id, left(content, 150) AS content_preview, chunk_index FROM chunks WHERE doc_id = 7"""

O["content_hash_query"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"

O["find_by_content_hash"] = """WITH h AS (SELECT doc_id, lang, sha256(text) AS content_hash FROM documents),
s AS (SELECT content_hash, doc_id AS match_id, CASE WHEN lang = 'en' THEN 'advanced' ELSE 'basic' END AS match_module FROM h
      QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY lang = 'en', doc_id) = 1)
SELECT h.content_hash, h.doc_id, s.match_id, s.match_module FROM h LEFT JOIN s USING (content_hash)"""

O["source_index"] = f"""WITH {URLS}
SELECT url_key, page_id AS match_id, CASE WHEN scheme = 'https' THEN 'basic' ELSE 'advanced' END AS match_module FROM k
QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY scheme <> 'https', page_id) = 1"""

O["skip_known"] = f"""WITH {URLS}
SELECT page_id AS doc_id, url_key FROM k WHERE url LIKE '%?%' AND url_key NOT IN (SELECT url_key FROM k WHERE url NOT LIKE '%?%')"""

O["override_known"] = f"""WITH {URLS},
s AS (SELECT page_id, url_key FROM k WHERE url NOT LIKE '%?%'), n AS (SELECT page_id, url_key FROM k WHERE url LIKE '%?%'),
m AS (SELECT min(page_id) AS page_id FROM s WHERE url_key IN (SELECT url_key FROM n) GROUP BY url_key)
SELECT page_id AS doc_id, url_key, 'kept' AS state FROM s WHERE page_id NOT IN (SELECT page_id FROM m)
UNION ALL SELECT page_id, url_key, 'ingested' FROM n"""

O["dedup_in_batch"] = "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)"

O["existing_sources"] = f"WITH {URLS} SELECT DISTINCT url_key FROM k"

O["url_key"] = f"WITH {URLS} SELECT page_id, url_key, host FROM k"

CANON = URLS + """,
canon AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT
            list_contains(['ref', 'source', 'fbclid'], string_split(p, '=')[1]))) AS kept,
   regexp_replace(regexp_replace(path, '(.)/$', '\\1'), '/index\\.html$', '/') AS slim FROM k)"""
O["canonical_url"] = f"""WITH {CANON}
SELECT page_id, origin || slim || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS canonical FROM canon"""

O["in_scope"] = f"""WITH {URLS}
SELECT page_id, starts_with(lower(path), '/en/') AND NOT regexp_matches(lower(path), '\\.(?!html$|htm$|xhtml$)[^/]*$') AS in_scope FROM k""".replace(
    "NOT regexp_matches(lower(path), '\\.(?!html$|htm$|xhtml$)[^/]*$')",
    "(NOT contains(regexp_extract(path, '[^/]*$'), '.') OR regexp_matches(path, '\\.(html|htm|xhtml)$'))")

O["select_family"] = f"""WITH {CANON},
fam AS (SELECT *, host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '' AND
   NOT regexp_full_match(lower(s), 'rc\\d*|alpha|beta|snapshot|nightly|dev|next|latest|stable|current|main|master|v?\\d[\\w.-]*')), '/') AS family FROM canon)
SELECT origin || '/' AS start, arg_min(url, [length(path)::VARCHAR.lpad(6, '0'), path, page_id::VARCHAR.lpad(9, '0')]) AS url, min(page_id) AS pos
FROM fam GROUP BY origin, family"""

O["structural_order"] = f"""WITH {URLS},
d AS (SELECT DISTINCT origin || '/' AS start, url, length(url) AS n, regexp_replace(path, '[^/]*$', '') AS dir FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY start, dir ORDER BY n, url) AS rnd FROM d),
f AS (SELECT r.*, h.n AS hn, h.url AS hu FROM r JOIN r h ON h.start = r.start AND h.dir = r.dir AND h.rnd = 1)
SELECT start, url, row_number() OVER (PARTITION BY start ORDER BY rnd, hn, hu) AS position FROM f"""

O["robots_allows"] = f"""WITH {URLS},
f AS (SELECT host, arg_min(url, page_id) AS url FROM k GROUP BY host),
r AS (SELECT host, '/' || string_split(url, '/')[4] || '/' AS rule FROM f)
SELECT k.page_id, k.url FROM k JOIN r USING (host) WHERE NOT starts_with(regexp_replace(path, '(.)/$', '\\1'), rule)"""

# Every page is listed by a sitemap of its own, so all that are in scope of their site remain.
O["expand_sitemaps"] = f"""WITH {CANON},
named AS (SELECT origin || '/' AS start, origin, host, path, min(page_id) AS page_id,
    origin || slim || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url FROM canon
  WHERE NOT regexp_matches(path, '/search|/login|/signin|/logout|/cart|/feed|/print/|/cdn-cgi/')
    AND (NOT contains(regexp_extract(path, '[^/]*$'), '.') OR regexp_matches(path, '\\.(html|htm|xhtml)$')) GROUP BY ALL),
fam AS (SELECT start, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p, host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '' AND
   NOT regexp_full_match(lower(s), 'rc\\d*|alpha|beta|snapshot|nightly|dev|next|latest|stable|current|main|master|v?\\d[\\w.-]*')), '/') AS family FROM named)
SELECT DISTINCT ON (start, family) start, url FROM fam ORDER BY start, family, length(p), p, url"""

O["discover"] = r"""WITH hr AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
    regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1) AS h FROM pages),
l AS (SELECT DISTINCT origin || '/p' || page_id || '.html' AS start, origin || unnest(h) AS url FROM hr),
ok AS (SELECT start, url FROM l WHERE NOT contains(regexp_extract(url, '[^/]*$'), '.')
   AND NOT regexp_matches(lower(url), '^[a-z]+://[^/]+.*(/search|/login|/signin|/logout|/cart|/feed|/print/|/cdn-cgi/)')),
f AS (SELECT DISTINCT ON (start, fam) start, url FROM (SELECT *, CASE WHEN regexp_full_match(lower(regexp_extract(url, '[^/]*$')),
   'rc\d*|alpha|beta|snapshot|nightly|dev|next|latest|stable|current|main|master|v?\d[\w.-]*') THEN '' ELSE url END AS fam FROM ok)
   ORDER BY start, fam, length(url), url)
SELECT start, url, row_number() OVER (PARTITION BY start ORDER BY length(url), url) AS position FROM f"""

O["rank_links"] = f"""WITH {NAV},
s AS (SELECT page_id, pos::BIGINT AS pos, link, (2 * (contains(lower(link), 'that')::INT + contains(lower(link), 'other')::INT
   + contains(lower(link), 'there')::INT))::BIGINT AS score FROM resolved)
SELECT page_id, link, pos, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s"""

O["top_links"] = f"""WITH {NAV}, {URLS},
s AS (SELECT page_id, pos, link, (CASE WHEN starts_with(lower(link), 'http') THEN 0 ELSE 1 END
   + 2 * (contains(lower(link), 'that')::INT + contains(lower(link), 'other')::INT + contains(lower(link), 'there')::INT))::BIGINT AS score FROM resolved),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 5),
t AS (SELECT url_key, arg_min(page_id, url) AS target_id FROM k GROUP BY url_key)
SELECT b.page_id, b.rank, b.link, b.score, t.target_id FROM b
LEFT JOIN t ON t.url_key = regexp_replace(regexp_extract(b.link, '^[a-z]+://([^?#]*)', 1), '(.)/$', '\\1')"""

# The pages' own links lead out of the table, so a session visits its start and then its seeds.
O["crawl_bfs"] = f"""WITH {URLS},
d AS (SELECT DISTINCT origin || '/' AS start, url, url_key, length(url) AS n, regexp_replace(path, '[^/]*$', '') AS dir FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY start, dir ORDER BY n, url) AS rnd FROM d),
f AS (SELECT r.*, h.n AS hn, h.url AS hu FROM r JOIN r h ON h.start = r.start AND h.dir = r.dir AND h.rnd = 1),
o AS (SELECT start, url_key, row_number() OVER (PARTITION BY start ORDER BY rnd, hn, hu) AS position FROM f),
stored AS (SELECT DISTINCT url_key FROM k WHERE url LIKE '%?%'),
nodes AS (SELECT url_key, min(url) AS url FROM k GROUP BY url_key),
seeds AS (SELECT k.page_id, o.url_key, min(o.position) AS position FROM k JOIN o ON o.start = k.origin || '/'
          WHERE o.url_key <> k.url_key AND o.url_key NOT IN (SELECT url_key FROM stored) GROUP BY ALL),
v AS (SELECT page_id AS session, url_key, 0 AS level, 0 AS at FROM k UNION ALL SELECT page_id, url_key, 1, position FROM seeds)
SELECT v.session, n.url, v.level::BIGINT AS level, row_number() OVER (PARTITION BY v.session ORDER BY v.at) AS visit,
       v.url_key NOT IN (SELECT url_key FROM stored) AS ingested
FROM v JOIN nodes n USING (url_key) QUALIFY visit <= 50"""

O["list_conversations"] = """SELECT conv_id, coalesce(t, 'New conversation') AS title, n AS messages FROM (
  SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t, count(*) AS n FROM conversations GROUP BY conv_id)"""

O["list_messages"] = "SELECT turn, role, text FROM conversations WHERE conv_id = 3"

O["append_messages"] = """WITH n AS (SELECT conv_id * 2 AS conv_id, turn + 1000 AS turn FROM conversations)
SELECT conv_id, turn, 'kept' AS state FROM conversations
UNION ALL SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM conversations) THEN 'kept' ELSE 'rejected' END FROM n"""

PRECISION = f"""{VEC_TOP},
tot AS (SELECT label, count(*) AS total FROM emb GROUP BY label),
pr AS (SELECT query_id, count(*) FILTER (ql = cl) AS found, count(*) AS got, any_value(tot.total) AS total,
  min(rank) FILTER (ql = cl) AS first FROM top JOIN tot ON tot.label = top.ql GROUP BY query_id)"""
O["precision_recall"] = f"""WITH {PRECISION}
SELECT query_id, round(found / got, 6) AS precision_at_k, round(found / total, 6) AS recall_at_k, coalesce(round(1.0::DOUBLE / first, 6), 0.0) AS reciprocal_rank FROM pr"""

O["mrr"] = f"""WITH {VEC_TOP}, f AS (SELECT q.vec_id, min(top.rank) FILTER (top.ql = top.cl) AS r
  FROM emb q LEFT JOIN top ON top.query_id = q.vec_id AND top.query_id <> top.chunk_id GROUP BY q.vec_id)
SELECT round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr, count(*) AS questions FROM f"""

O["compare_runs"] = f"""WITH {PRECISION},
srank AS (SELECT query_id, ql, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vp WHERE ql = cl QUALIFY rank <= 10),
sp AS (SELECT query_id, count(*) AS found, any_value(tot.total) AS total FROM srank JOIN tot ON tot.label = srank.ql GROUP BY query_id),
a AS (SELECT 'whole' AS method, round(found / got, 6) AS p, round(found / total, 6) AS r, coalesce(round(1.0::DOUBLE / first, 6), 0.0) AS m FROM pr
      UNION ALL SELECT 'scoped', 1.0, round(found / total, 6), 1.0 FROM sp)
SELECT method, round(avg(p), 6) AS precision_at_k, round(avg(r), 6) AS recall_at_k, round(avg(m), 6) AS mrr FROM a GROUP BY method"""

O["event_rates"] = """WITH slots AS (SELECT event_type, value, (floor(epoch(ts))::BIGINT // 60) * 60 - 60 * unnest(range(0, 5)) AS window_start FROM events)
SELECT window_start::BIGINT AS window_start, event_type, count(*) AS events, round(count(*) / 300, 9) AS rate, round(sum(value) / 300, 6) AS value_rate
FROM slots GROUP BY ALL"""
O["stream_rates"] = """WITH slots AS (SELECT event_type, (floor(epoch(ts))::BIGINT // 60) * 60 - 60 * unnest(range(0, 5)) AS window_start FROM events)
SELECT window_start::BIGINT AS window_start, event_type, count(*) AS events, round(count(*) / 300, 9) AS rate FROM slots GROUP BY ALL"""

O["window_percentiles"] = """SELECT (floor(epoch(ts))::BIGINT // 86400) * 86400 AS window_start, event_type, count(*) AS n,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL"""
O["stream_percentiles"] = O["window_percentiles"]

# Hours that ended ten minutes before the last event are closed; a window has six of them.
O["stream_sliding_percentiles"] = """WITH e AS (SELECT event_type, value, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS hour FROM events),
closed AS (SELECT * FROM e WHERE hour + 3600 <= (SELECT max(epoch_ms(ts)) / 1000.0 - 600 FROM events)),
w AS (SELECT event_type, value, hour - 3600 * unnest(range(0, 6)) AS window_start FROM closed)
SELECT window_start::BIGINT AS window_start, event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  0.0::DOUBLE AS rank_error FROM w GROUP BY window_start, event_type"""

O["token_cost"] = """WITH usage AS (SELECT 'p' || conv_id % 4 AS provider_id, (conv_id % 50 + 1)::VARCHAR AS model_id,
  sum(CASE WHEN role = 'user' THEN length(text) // 4 ELSE 0 END)::BIGINT AS input_tokens,
  sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) // 4 END)::BIGINT AS output_tokens FROM conversations GROUP BY ALL),
prices AS (SELECT p_size::VARCHAR AS model_id, min(p_retailprice) AS ci, max(p_retailprice) AS co FROM part GROUP BY ALL)
SELECT provider_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  round(sum((input_tokens * coalesce(ci, 0) + output_tokens * coalesce(co, 0)) / 1000000), 6) AS cost
FROM usage LEFT JOIN prices USING (model_id) GROUP BY provider_id"""

O["stream_ingest"] = f"WITH {FIXED} SELECT chunk_id, doc_id, chunk_index, content FROM chunks"

O["stream_dedup"] = "SELECT DISTINCT sha256(props) AS content_hash, props FROM events"

O["stream_job_state"] = """SELECT user_id AS doc_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
  WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS state, floor(value)::BIGINT AS chunk_count, props AS message, epoch_us(ts) AS ts
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1"""

O["stream_sessions"] = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS fresh FROM events),
n AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end, count(*) AS events FROM n GROUP BY user_id, s"""

O["stream_retention"] = """WITH j AS (SELECT event_id AS doc_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
  WHEN 'click' THEN 'RUNNING' ELSE 'PENDING' END AS state, ts FROM events),
f AS (SELECT * FROM j WHERE state IN ('COMPLETED', 'FAILED') AND ts >= (SELECT max(ts) FROM j) - INTERVAL 10 DAY ORDER BY ts DESC, doc_id LIMIT 1000)
SELECT doc_id, state, epoch_us(ts) AS ts FROM f UNION ALL SELECT doc_id, state, epoch_us(ts) FROM j WHERE state NOT IN ('COMPLETED', 'FAILED')"""

ORACLES = O
