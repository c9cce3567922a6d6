"""The registered queries as SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from glosspan.functions.stopwords import STOPWORDS
from glosspan.functions.text import TOKEN, WORD
from glosspan.operators.chunking import ABBREVIATIONS, CLOSING, OPENING
from glosspan.plans.queries import PRICES, QUERY

_GAP = WORD.replace("[^", "[").rstrip("+")
_CLOSING, _OPENING = (signs.replace("'", "''") for signs in (CLOSING, OPENING))
_ABBREVIATIONS = ", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_DOCS = "docs AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS source, coalesce(text, '') AS text, doc_id AS seq FROM documents)"


def _chunks(size: int = 200, overlap: int = 40, name: str = "chunks") -> str:
    step = size - overlap
    return f"""{name} AS (
  SELECT substr(sha1(source), 1, 10) || '-' || p AS id, source, p::INT AS position, content_hash,
         array_to_string(list_slice(ws, p * {step} + 1, p * {step} + {size}), ' ') AS text, seq * 16777216 + p AS seq, seq AS doc
  FROM (SELECT *, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= {size} THEN 1 ELSE 1 + ceil((len(ws) - {size}) / {step}::DOUBLE)::INT END)) AS p
        FROM (SELECT source, seq, sha256(text) AS content_hash, regexp_extract_all(text, '{WORD}') AS ws FROM docs)))"""


def _terms(source: str, keys: str, text: str = "text") -> str:
    return f"SELECT {keys}, lower(t) AS term FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '{TOKEN}')) AS t FROM {source}) WHERE lower(t) NOT IN ({_STOP})"


_INDEX = f"""WITH {_DOCS}, {_chunks()},
post AS (SELECT id, source, seq, term, count(*) AS tf FROM ({_terms("chunks", "id, source, seq")}) GROUP BY ALL),
lens AS (SELECT id, sum(tf) AS length FROM post GROUP BY 1)"""
_STAMPED = """stamped AS (SELECT *, CASE WHEN doc % 3 = 0 THEN '' ELSE '2026-01-' || lpad((1 + doc % 28)::VARCHAR, 2, '0') || 'T00:00:00+00:00' END AS indexed_at FROM chunks)"""
_ONE = f"q AS (SELECT 'q' AS query_id, '{QUERY}' AS query)"
_ITEMS = "q AS (SELECT item_id::VARCHAR AS query_id, text AS query FROM benchmark)"


def _bm25(queries: str = _ONE) -> str:
    """CTEs up to ``shares`` and ``ranks`` (query_id, id, source, seq, score, rank)."""
    return f"""{_INDEX}, {queries},
qt AS (SELECT query_id, term, count(*) AS times FROM ({_terms("q", "query_id", "query")}) GROUP BY ALL),
tot AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(tf) FROM post) / count(*)::DOUBLE AS avg_len FROM chunks),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
shares AS (
  SELECT query_id, p.id, p.source, p.seq, term, times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_len)) AS share
  FROM post p JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (id), tot),
scores AS (SELECT query_id, id, source, seq, sum(share) AS score FROM shares GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank FROM scores)"""


def _scoped(keep: str) -> str:
    return f"""{_bm25()},
depth AS (SELECT CASE WHEN kept = 0 THEN 0 ELSE least(total, ceil(10 * total / kept::DOUBLE)) END AS depth FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {keep}) AS kept FROM chunks))
SELECT row_number() OVER (ORDER BY rank)::INT AS rank, id, source, round(score, 6) AS score FROM ranks, depth WHERE rank <= depth AND {keep} ORDER BY rank LIMIT 10"""


def _encoded(text: str) -> str:
    return f"replace(replace(replace(url_encode({text}), '+', '%20'), '-', '%2D'), '*', '%2A')"


def _spans(name: str, chunks: str) -> str:
    """(source, id, position, a, b): where the words of chunks first stand in their documents, as code points."""
    return f"""{name}_d AS (SELECT source, ws, list_transform(gs, lambda x: length(x)) AS gl, list_transform(ws, lambda x: length(x)) AS wl, ' ' || array_to_string(ws, ' ') || ' ' AS flat
  FROM (SELECT source, regexp_extract_all(text, '{WORD}') AS ws, regexp_split_to_array(text, '{WORD}') AS gs FROM docs)),
{name}_p AS (SELECT c.source, c.id, c.position, gl, wl, len(regexp_extract_all(c.text, '{WORD}')) AS n,
  len(string_split(substr(flat, 1, instr(flat, ' ' || c.text || ' ')), ' ')) - 1 AS i FROM {chunks} c JOIN {name}_d d USING (source)),
{name} AS (SELECT source, id, position, (list_sum(gl[:i]) + coalesce(list_sum(wl[:i - 1]), 0))::INT AS a, (list_sum(gl[:i + n - 1]) + list_sum(wl[:i + n - 1]))::INT AS b FROM {name}_p)"""


_CASES = f"""iw AS (SELECT item_id::VARCHAR AS query_id, regexp_extract_all(text, '{WORD}') AS ws FROM benchmark),
dw AS (SELECT source, ' ' || array_to_string(regexp_extract_all(text, '{WORD}'), ' ') || ' ' AS body FROM docs),
cases AS (SELECT query_id, list_sort(list(DISTINCT source)) AS relevant FROM dw JOIN iw ON len(ws) > 0 AND contains(body, ' ' || array_to_string(ws, ' ') || ' ') GROUP BY 1)"""
_OUTCOMES = f"""{_bm25(_ITEMS)}, {_CASES},
labels AS (SELECT query_id, unnest(relevant) AS label, len(relevant) AS n FROM cases),
met AS (SELECT l.query_id, label, min(rank) AS rank FROM labels l JOIN ranks r ON l.query_id = r.query_id AND r.rank <= 5 AND (r.source = label OR ends_with(r.source, '/' || label)) GROUP BY ALL),
hits AS (SELECT query_id, min(rank) AS first_hit, list(rank) AS rs FROM met GROUP BY 1),
done AS (SELECT c.query_id, first_hit, [len(list_filter(coalesce(rs, []), lambda r: r <= k)) / len(relevant)::DOUBLE for k in range(1, 6)] AS curve FROM cases c LEFT JOIN hits USING (query_id))"""
_WEIGHTS = f"""{_INDEX},
tf AS (SELECT source, term, sum(tf) AS tf FROM post WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\\p{{Nd}}+') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weighed AS (SELECT source, term, tf * ln((1.0 + (SELECT count(DISTINCT source) FROM chunks)) / df) AS weight FROM tf JOIN df USING (term)),
doc_terms AS (SELECT * FROM (SELECT source, term, weight, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, term) AS rank FROM weighed) WHERE rank <= 10)"""


def _hashed(source: str, key: str, text: str) -> str:
    """(key, vector) of the offline embedder."""
    return f"""SELECT {key}, list_transform(range(64), lambda i: coalesce(m[i], 0)::DOUBLE) AS vector FROM (
  SELECT {key}, map_from_entries(list((b, n))) AS m FROM (
    SELECT {key}, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS n FROM ({_terms(source, key, text)}) GROUP BY ALL) GROUP BY 1)"""


_PRICES = ", ".join(str(p) for p in PRICES)
_FILTERS = [("", "true"), ("*.txt", "ends_with(s, '.txt')"), (".TXT", "ends_with(s, '.txt')"), ("src3", "contains(p, '/src3/')"), ("SRC3/en", "contains(p, '/src3/en/')"), ("en", "contains(p, '/en/')"), ("src", "contains(p, '/src/')"), ("/", "false"), ("https://", "starts_with(s, 'https://')"), ("https://ex", "starts_with(s, 'https://ex')"), ("src1\\de", "contains(p, '/src1/de/')")]

ORACLES = {
    "chunk_window": f"WITH {_DOCS}, {_chunks()} SELECT id, source, position, text, content_hash, source AS citation FROM chunks",
    "tokens_stats": f"{_INDEX} SELECT count(*) AS chunks, sum(n)::BIGINT AS tokens, sum(d)::BIGINT AS distinct_tokens, max(n)::BIGINT AS longest FROM (SELECT id, sum(tf) AS n, count(*) AS d FROM post GROUP BY 1)",
    "top_terms": f"{_INDEX} SELECT term, sum(tf)::BIGINT AS count FROM post GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "index_stats": f"{_INDEX}, t AS (SELECT term, sum(tf)::BIGINT AS n FROM post GROUP BY 1) SELECT (SELECT count(DISTINCT source) FROM chunks) AS documents, (SELECT count(*) FROM chunks) AS chunks, sum(n)::BIGINT AS terms, count(*) AS vocabulary, (SELECT string_agg(term || ':' || n, ',' ORDER BY n DESC, term) FROM (SELECT * FROM t ORDER BY n DESC, term LIMIT 10)) AS top_terms FROM t",
    "bm25_search": f"""{_bm25()},
words AS (SELECT id, lower(w) AS w, i FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT c.id, regexp_extract_all(c.text, '{TOKEN}') AS ws FROM chunks c JOIN ranks r ON c.id = r.id WHERE r.rank <= 10))),
met AS (SELECT id, string_agg(w, ',' ORDER BY i) AS matched_terms FROM (SELECT id, w, min(i) AS i FROM words WHERE w IN (SELECT term FROM qt) GROUP BY ALL) GROUP BY 1)
SELECT rank::INT AS rank, id, source, round(score, 6) AS score, matched_terms FROM ranks JOIN met USING (id) WHERE rank <= 10""",
    "bm25_batch": f"{_bm25(_ITEMS)} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM ranks WHERE rank <= 5",
    "bm25_bounded": f"{_bm25(_ITEMS)} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM ranks WHERE rank <= 5",
    "scoped_exact": f"{_bm25(_ITEMS)} SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, id, round(score, 6) AS score FROM ranks WHERE contains('/' || lower(source) || '/', '/src3/en/')) WHERE rank <= 5",
    "dense_batch": "SELECT * FROM (SELECT q.vec_id::VARCHAR AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 6) AS score FROM (SELECT q.vec_id AS q, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q) JOIN embeddings q ON q.vec_id = q WHERE score > 0) WHERE rank <= 5",
    "bm25_explain": f"{_bm25()} SELECT r.rank::INT AS rank, id, (row_number() OVER (PARTITION BY id ORDER BY share DESC, term) - 1)::INT AS place, term, round(share, 6) AS share FROM shares JOIN ranks r USING (query_id, id) WHERE r.rank <= 10",
    "bm25_scoped_type": _scoped("ends_with(lower(source), '.txt')"),
    "bm25_scoped_folder": _scoped("contains('/' || lower(source) || '/', '/src3/en/')"),
    "bm25_scoped_url": _scoped("starts_with(lower(source), 'https://example.com')"),
    "source_filters": f"WITH {_DOCS}, s AS (SELECT lower(trim(source)) AS s, '/' || array_to_string(list_filter(string_split(lower(trim(source)), '/'), lambda x: x <> ''), '/') || '/' AS p FROM (SELECT source FROM docs UNION ALL SELECT url FROM pages)) " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE {c}) AS kept FROM s" for p, c in _FILTERS),
    "dense_search": "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 6) AS score FROM (SELECT e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings e) WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 10",
    "hybrid_rrf": f"""{_bm25()},
qv AS ({_hashed("q", "query_id", "query")}),
cv AS ({_hashed("chunks", "id", "text")}),
ds AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, seq) AS rank FROM (SELECT cv.id, c.seq, list_cosine_similarity(cv.vector, qv.vector) AS score FROM cv JOIN chunks c USING (id), qv) WHERE score > 0),
votes AS (SELECT id, rank FROM ranks WHERE rank <= 50 UNION ALL SELECT id, rank FROM ds WHERE rank <= 50),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM votes GROUP BY 1)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 6) AS score FROM f ORDER BY round(score, 9) DESC, id LIMIT 10""",
    "rerank_grades": f"""{_bm25()},
g AS (SELECT r.id, r.rank, floor(10 * (SELECT count(*) FROM post p JOIN qt USING (term) WHERE p.id = r.id) / (SELECT count(*) FROM qt)::DOUBLE)::INT AS grade FROM ranks r WHERE rank <= 20)
SELECT row_number() OVER (ORDER BY grade DESC, rank)::INT AS rank, id, grade FROM g ORDER BY grade DESC, rank LIMIT 10""".replace("SELECT row_number() OVER (ORDER BY grade DESC, rank)::INT AS rank, id, grade FROM g ORDER BY grade DESC, rank LIMIT 10", "SELECT n::INT AS rank, id, grade FROM (SELECT *, row_number() OVER (ORDER BY grade DESC, rank) AS n FROM g) WHERE n <= 10"),
    "grades_parsed": "SELECT item_id::VARCHAR AS query_id, 1 AS passage, greatest(0, least(10, length(text) % 13 - 1))::INT AS grade FROM benchmark UNION ALL SELECT item_id::VARCHAR, 2, 10 FROM benchmark",
    "sentence_chunks": f"""WITH RECURSIVE {_DOCS},
w AS (SELECT source, regexp_extract_all(text, '{WORD}') AS ws, regexp_split_to_array(text, '{WORD}') AS gs FROM docs),
x AS (SELECT source, ws, gs, list_transform(ws, lambda y: rtrim(y, '{_CLOSING}')) AS stems, list_transform(ws, lambda y: substr(ltrim(y, '{_OPENING}'), 1, 1)) AS heads FROM w WHERE len(ws) > 0),
c AS (SELECT source, ws, list_filter(range(1, len(ws) + 1), lambda i: i = len(ws) OR regexp_matches(gs[i + 1], '\\n[ \\t]*\\r?\\n')
    OR (right(stems[i], 1) IN ('.', '!', '?', '…') AND NOT list_contains([{_ABBREVIATIONS}], lower(rtrim(stems[i], '.'))) AND NOT (heads[i + 1] = lower(heads[i + 1]) AND heads[i + 1] <> upper(heads[i + 1])))) AS ends FROM x),
e AS (SELECT source, ws, list_sort(list_distinct(flatten(list_transform(range(1, len(ends) + 1), lambda k: range(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END, ends[k], 200))) || [len(ws)])) AS edges FROM c),
p(source, a, position) AS (
  SELECT source, 1::BIGINT, 0 FROM e
  UNION ALL SELECT source, z, position + 1 FROM (
    SELECT p.source, p.position, edges, s, greatest(a + 1, len(list_filter(edges, lambda v: v < edges[s] - 40)) + 1) AS z
    FROM (SELECT p.source, p.a, p.position, edges, len(list_filter(edges, lambda v: v <= edges[p.a] + 200)) AS s FROM p JOIN e USING (source)) p) WHERE s < len(edges))
SELECT substr(sha1(source), 1, 10) || '-' || position AS id, source, position::INT AS position,
  array_to_string(ws[edges[a] + 1:edges[len(list_filter(edges, lambda v: v <= edges[a] + 200))]], ' ') AS text FROM p JOIN e USING (source)""",
    "highlights": f"""WITH {_DOCS},
t AS (SELECT source, unnest(regexp_extract_all(text, '({TOKEN}|[^\\p{{L}}\\p{{N}}_]+)')) AS piece, generate_subscripts(regexp_extract_all(text, '({TOKEN}|[^\\p{{L}}\\p{{N}}_]+)'), 1) AS i FROM docs),
o AS (SELECT source, lower(piece) AS w, sum(length(piece)) OVER (PARTITION BY source ORDER BY i) AS stop, length(piece) AS n FROM t),
q AS (SELECT '{QUERY}' AS query), qt AS (SELECT DISTINCT term FROM ({_terms("q", "query", "query")}))
SELECT source, count(*) AS hits, min(stop - n)::INT AS first, max(stop)::INT AS last, sum(stop - n)::BIGINT AS starts FROM o WHERE w IN (SELECT term FROM qt) GROUP BY 1""",
    "passage_spans": f"WITH {_DOCS}, {_chunks(50, 10)}, {_spans('sp', 'chunks')} SELECT source, position, a AS start, b AS \"end\" FROM sp",
    "docs_by_type": f"WITH {_DOCS} SELECT CASE WHEN starts_with(lower(source), 'http') THEN 'web' ELSE 'txt' END AS type, count(*) AS documents FROM (SELECT DISTINCT c.source FROM docs c WHERE length(regexp_extract(text, '{WORD}')) > 0 UNION SELECT DISTINCT url FROM pages) GROUP BY 1",
    "chunk_histogram": f"""WITH {_DOCS}, {_chunks()},
v AS (SELECT len(regexp_extract_all(text, '{WORD}')) AS n FROM chunks),
e AS (SELECT min(n) AS lo, max(n) AS hi, greatest(1, ceil((max(n) - min(n) + 1) / 10.0))::BIGINT AS width FROM v),
g AS (SELECT unnest(range(lo, hi + 1, width)) AS low, hi, width FROM e)
SELECT low, least(low + width - 1, hi)::BIGINT AS high, count(n) AS count FROM g LEFT JOIN v ON n >= low AND n < low + width GROUP BY low, hi, width""",
    "recent_documents": f"WITH {_DOCS}, {_chunks()}, {_STAMPED} SELECT source, max(indexed_at) AS indexed_at, count(*) AS chunks FROM stamped GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "catalog": f"WITH {_DOCS}, {_chunks()} SELECT source, count(*)::INT AS chunks, string_agg(id, ',' ORDER BY position) AS chunk_ids FROM chunks GROUP BY 1",
    "doc_top_terms": f"{_WEIGHTS} SELECT source, rank::INT AS rank, term, round(weight, 6) AS weight FROM doc_terms",
    "doc_relations": f"{_WEIGHTS} SELECT a.source AS first, b.source AS second, count(*)::INT AS strength, string_agg(a.term, ',' ORDER BY a.term) AS shared_terms FROM doc_terms a JOIN doc_terms b ON a.term = b.term AND a.source < b.source GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 30",
    "eval_outcomes": f"{_OUTCOMES} SELECT query_id, first_hit::INT AS first_hit, array_to_string([printf('%.4f', x) for x in curve], ',') AS recall_curve FROM done",
    "eval_report": f"{_OUTCOMES} SELECT count(*) AS cases, round(coalesce(avg(curve[5]), 0), 6) AS recall, round(coalesce(avg(coalesce(1.0 / first_hit, 0)), 0), 6) AS mrr FROM done",
    "cited_documents": f"{_bm25()}, {_STAMPED} SELECT r.source, max(indexed_at) AS indexed_at, min(rank)::INT AS best_rank, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks FROM ranks r JOIN stamped s USING (id) WHERE rank <= 20 GROUP BY 1",
    "answer_overlap": _bm25("q AS (SELECT 'q' AS query_id, '" + QUERY + "' AS query UNION ALL SELECT 'r', 'eronly thonan')") + ", a AS (SELECT id FROM ranks WHERE query_id = 'q' AND rank <= 10), b AS (SELECT id FROM ranks WHERE query_id = 'r' AND rank <= 10), s AS (SELECT count(*) AS n FROM a JOIN b USING (id)), u AS (SELECT count(DISTINCT id) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT s.n::INT AS shared, round(CASE WHEN u.n = 0 THEN 1 ELSE s.n / u.n::DOUBLE END, 6) AS overlap FROM s, u",
    "usage_cost": f"""WITH p AS (SELECT * FROM (VALUES {_PRICES}) v(name, input, output, cache_read)),
u AS (SELECT conv_id, turn, ['base', 'base-large-2', 'mini-1', 'other', 'basement'][(conv_id % 5 + 1)::INT] AS model, length(coalesce(text, '')) AS n FROM conversations),
b AS (SELECT conv_id, turn, u.model, n, arg_max((input::DOUBLE, output::DOUBLE, cache_read::DOUBLE), length(name)) AS x FROM u LEFT JOIN p ON u.model = name OR starts_with(u.model, name || '-') GROUP BY ALL)
SELECT conv_id, turn, model, round((n * x[1] + n % 97 * x[2] + CASE WHEN turn % 2 = 0 THEN n % 31 ELSE 0 END * x[1] * 1.25 + n % 53 * x[3]) / 1e6, 6) AS cost_usd FROM b""",
    "chat_window": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "prompt_budget": f"""WITH {_DOCS}, {_chunks()},
u AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS used FROM chunks WINDOW w AS (PARTITION BY source ORDER BY position)),
k AS (SELECT *, n = 1 OR NOT max(used > 2500) OVER (PARTITION BY source ORDER BY position) AS keep FROM u)
SELECT source, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS omitted, sum(length(text)) FILTER (WHERE keep)::BIGINT AS chars FROM k GROUP BY 1""",
    "segments_merge": f"""{_bm25()}, best AS (SELECT c.source, c.id, c.position, c.text FROM chunks c JOIN ranks USING (id) WHERE rank <= 200), {_spans('sp', 'best')},
s AS (SELECT sp.source, a, b, rank AS r FROM sp JOIN ranks USING (id)),
f AS (SELECT *, CASE WHEN a >= coalesce(max(b) OVER (PARTITION BY source ORDER BY a, b, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS begins FROM s),
i AS (SELECT *, sum(begins) OVER (PARTITION BY source ORDER BY a, b, r ROWS UNBOUNDED PRECEDING) AS seg FROM f)
SELECT source, min(a)::INT AS start, max(b)::INT AS "end", string_agg(r::VARCHAR, ',' ORDER BY r) AS ranks FROM i GROUP BY source, seg""",
    "paged_windows": f"""WITH o AS (SELECT source, string_split(text, chr(10)) AS pages FROM (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS source, coalesce(text, '') AS text FROM documents)),
p AS (SELECT source, array_to_string(pages, chr(10) || chr(10)) AS text, list_transform(range(len(pages)), lambda i: coalesce(list_sum(list_transform(pages[:i], lambda x: length(x) + 2)), 0)) AS starts FROM o),
w AS (SELECT source, starts, regexp_extract_all(text, '{WORD}') AS ws, list_transform(regexp_split_to_array(text, '{WORD}'), lambda x: length(x)) AS gl FROM p),
c AS (SELECT *, unnest(range(CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 60 THEN 1 ELSE 1 + ceil((len(ws) - 60) / 48.0)::INT END)) AS n FROM (SELECT *, list_transform(ws, lambda x: length(x)) AS wl FROM w)),
b AS (SELECT source, n, starts, n * 48 + 1 AS i, least(n * 48 + 60, len(ws)) AS j, gl, wl FROM c),
f AS (SELECT source, n, greatest(1, len(list_filter(starts, lambda x: x <= list_sum(gl[:i]) + coalesce(list_sum(wl[:i - 1]), 0)))) AS a, greatest(1, len(list_filter(starts, lambda x: x <= list_sum(gl[:j]) + coalesce(list_sum(wl[:j - 1]), 0)))) AS z FROM b)
SELECT substr(sha1(source), 1, 10) || '-' || n AS id, n::INT AS position, a::INT AS first_page, z::INT AS last_page, source || CASE WHEN a = z THEN ', p. ' || a ELSE ', pp. ' || a || '-' || z END AS citation FROM f""",
    "emphasized": f"""WITH {_DOCS},
t AS (SELECT source, unnest(regexp_extract_all(text, '({TOKEN}|[^\\p{{L}}\\p{{N}}_]+)')) AS piece, generate_subscripts(regexp_extract_all(text, '({TOKEN}|[^\\p{{L}}\\p{{N}}_]+)'), 1) AS i FROM docs),
q AS (SELECT '{QUERY}' AS query), qt AS (SELECT DISTINCT term FROM ({_terms("q", "query", "query")})),
m AS (SELECT source, i, piece, lower(piece) IN (SELECT term FROM qt) AS hit FROM t),
e AS (SELECT source, md5(string_agg(CASE WHEN hit THEN '**' || piece || '**' ELSE piece END, '' ORDER BY i)) AS text_md5, count(*) FILTER (WHERE hit) AS hits FROM m GROUP BY 1)
SELECT source, coalesce(text_md5, md5('')) AS text_md5, coalesce(hits, 0)::INT AS hits FROM docs LEFT JOIN e USING (source)""",
    "source_hrefs": f"WITH {_DOCS} SELECT '/my docs/' || source AS source, 'file:///my%20docs/' || source || CASE WHEN seq % 2 = 0 THEN '#page=' || seq % 9 ELSE '' END AS href FROM docs UNION ALL SELECT url, url FROM pages",
    "document_labels": f"WITH {_DOCS}, n AS (SELECT DISTINCT source || '/' || seq % 400 || '.txt' AS source, seq % 400 || '.txt' AS name FROM docs) SELECT source, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN source ELSE name END AS label FROM n",
    "edge_labels": f"{_WEIGHTS}, p AS (SELECT a.source AS first, b.source AS second, count(*) AS n, list_sort(list(a.term)) AS ts FROM doc_terms a JOIN doc_terms b ON a.term = b.term AND a.source < b.source GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 30) SELECT first, second, array_to_string(ts[:3], ', ') || CASE WHEN n > 3 THEN ' +' || (n - 3) ELSE '' END AS edge FROM p",
    "score_breakdown": f"{_bm25()} SELECT r.rank::INT AS rank, id, string_agg(term || ' ' || printf('%.2f', share), ' + ' ORDER BY share DESC, term) AS parts FROM shares JOIN ranks r USING (query_id, id) WHERE r.rank <= 10 GROUP BY 1, 2",
    "label_texts": """WITH u AS (SELECT conv_id, turn, length(coalesce(text, '')) * 37 AS n FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'soon' ELSE '2026-03-0' || (turn % 7 + 1) || ' 10:0' || conv_id % 10 || ' UTC' END AS indexed,
  'm: ' || format('{:,}', n) || ' input tokens' || CASE WHEN n % 3 > 0 THEN ' (' || format('{:,}', n % 3 * 1000) || ' cached)' ELSE '' END || ', ' || format('{:,}', n % 5000) || ' output tokens' || CASE WHEN turn % 2 = 0 THEN ', ~$' || printf('%.4f', round(n / 8192.0 + 1e-12, 4)) ELSE '' END AS usage FROM u""",
    "chunk_lookup": f"WITH {_DOCS}, {_chunks()}, m AS (SELECT source FROM chunks GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, position, sha256(text) AS text_sha FROM chunks JOIN m USING (source)",
    "ignored_files": f"WITH {_DOCS} SELECT '/w/' || source AS path FROM docs WHERE NOT starts_with(source, 'src1/en/')",
    "prompt_context": f"""{_bm25(_ITEMS)}, b AS (SELECT query_id, rank, '[' || rank || '] (source: ' || c.source || ')' || chr(10) || c.text AS block FROM ranks JOIN chunks c USING (id) WHERE rank <= 3)
SELECT query_id, md5('<context>' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || '</context>' || chr(10) || chr(10) || 'Question: Why?') AS prompt_md5 FROM b GROUP BY 1""",
    "citation_links": """WITH t AS (SELECT item_id, text AS head, item_id % 7 AS x, item_id % 5 AS y, item_id % 4 + 1 AS n FROM benchmark)
SELECT item_id, array_to_string(list_filter([CASE WHEN x BETWEEN 1 AND n THEN x END, CASE WHEN n >= 2 AND x <> 2 THEN 2 END], lambda v: v IS NOT NULL), ',') AS cited,
  head || CASE WHEN x BETWEEN 1 AND n THEN ' <' || x || '>' ELSE ' [' || x || ']' END || ' and ' || CASE WHEN n >= 2 THEN '<2>' ELSE '[2]' END || ', [' || y || '](x) [12] [007]' AS linked FROM t""",
    "text_fragments": f"""WITH {_DOCS}, {_chunks(14, 0)},
w AS (SELECT id, regexp_extract_all(text, '{WORD}') AS ws, regexp_extract_all(text, '{TOKEN}') AS ts FROM chunks),
q AS (SELECT '{QUERY}' AS query), qt AS (SELECT list(DISTINCT term) AS terms FROM ({_terms("q", "query", "query")})),
e AS (SELECT id, CASE WHEN len(ws) <= 12 THEN 'text=' || {_encoded("array_to_string(ws, ' ')")} ELSE 'text=' || {_encoded("array_to_string(ws[:6], ' ')")} || ',' || {_encoded("array_to_string(ws[-6:], ' ')")} END AS span,
  list_filter(ts, lambda t: list_contains(terms, lower(t))) AS met FROM w, qt),
d AS (SELECT id, span, list_filter(met, lambda t, i: list_position(met, t) = i)[:4] AS seen FROM e)
SELECT id, array_to_string(list_concat([span], list_transform(seen, lambda t: 'text=' || {_encoded("t")})), '&') AS directives FROM d""",
    "incremental_changed": f"WITH {_DOCS} SELECT source FROM docs WHERE seq % 7 = 0",
    "snapshot_diff": """WITH a AS (SELECT '/d/' || doc_id AS path, doc_id AS m, n_chars AS s FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT '/d/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN doc_id + 1 ELSE doc_id END AS m, n_chars AS s FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.m <> b.m OR a.s <> b.s""",
    "remove_path": f"WITH {_DOCS}, {_chunks()} SELECT source, count(*) AS chunks FROM chunks WHERE NOT (source = 'src3/en' OR starts_with(source, 'src3/en/')) GROUP BY 1",
    "remove_url": "SELECT url AS source FROM pages WHERE NOT (url = 'https://example.com/a' OR starts_with(url, 'https://example.com/a/'))",
    "dedup_hash": f"WITH {_DOCS} SELECT sha256(text) AS content_hash, count(*) AS copies, min(source) AS first FROM docs GROUP BY 1",
    "upsert_chunks": f"WITH {_DOCS}, {_chunks()} SELECT source, count(*) AS chunks, sum(length(CASE WHEN doc % 10 = 0 THEN substr(text, 1, 20) ELSE text END))::BIGINT AS chars FROM chunks GROUP BY 1",
    "loader_dispatch": "SELECT ['text', 'markdown', 'html', 'docx', 'pdf', 'skipped', 'skipped'][(doc_id % 7 + 1)::INT] AS loader, count(*) AS files FROM documents GROUP BY 1",
    "text_functions": f"""WITH {_DOCS}, f AS (SELECT *, length(text) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM docs)
SELECT source, CASE WHEN length(flat) > 40 THEN rtrim(substr(flat, 1, 40)) || '...' ELSE flat END AS preview,
  CASE WHEN n * 1000 < 1024 THEN n * 1000 || ' B' WHEN n * 1000 / 1024 < 1024 THEN printf('%.1f KB', n * 1000 / 1024) ELSE printf('%.1f MB', n * 1000 / 1048576) END AS size,
  CASE WHEN n % 3 = 1 THEN '1 page' ELSE n % 3 || ' pages' END AS pages, source = 'en/1.txt' OR ends_with(source, '/en/1.txt') AS matches, len(regexp_extract_all(text, '{WORD}')) AS words FROM f""",
    "vector_cache_missing": f"WITH {_DOCS} SELECT DISTINCT sha256(text) AS text_sha FROM docs WHERE sha256(text) NOT IN (SELECT sha256(text) FROM docs WHERE seq % 6 = 0)",
    "watch_apply": f"""WITH {_DOCS}, {_chunks()}, more AS (SELECT source, text || ' more words' AS text, seq FROM docs WHERE seq % 10 = 0 AND seq % 11 <> 0),
{_chunks(name="fresh").replace("FROM docs", "FROM more")}
SELECT source, count(*) AS chunks, '' AS indexed_at FROM chunks WHERE doc % 11 <> 0 AND doc % 10 <> 0 GROUP BY 1
UNION ALL SELECT source, count(*), '2026-01-01T00:00:00+00:00' FROM fresh GROUP BY 1""",
}
ORACLES |= {
    "chat_window_stream": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "sql_sentence_chunks": ORACLES["sentence_chunks"],
    "sql_search": ORACLES["bm25_explain"],
    "segmented_search": ORACLES["bm25_batch"],
    "folded_filters": f"WITH {_DOCS} SELECT ['Straße', 'STRASSE', 'ΣΟΦΟΣ', 'σοφος', 'plain'][seq % 5 + 1] || '/' || source AS source FROM docs WHERE seq % 5 < 4",
}
