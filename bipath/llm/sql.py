"""DuckDB SQL of the queries that SQL can express."""

_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_key(url: str) -> tuple[str, str]:
    """(columns of a step before, the key)."""
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '(?i)^https?://', '')"
    host = f"regexp_extract({bare}, '^([^/?]*)', 1)"
    rest = f"substr({bare}, length({host}) + 1)"
    name = f"regexp_replace(regexp_replace(lower({host}), '^www\\.', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/+$', '')"
    kept = (
        f"list_sort(list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')))"
    )
    return f"{name} || {path} AS head, {kept} AS kept", "head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"


_STEP, _KEY = _url_key("url")

OP1 = f"""
WITH responses AS (
  SELECT *, {_KEY} AS url_key FROM (
    SELECT page_id, html, '"' || md5(html) || '"' AS tag, 'day ' || (page_id % 28) AS day, {_STEP}
    FROM pages WHERE page_id % 13 <> 3)),
revisits AS (
  SELECT *, {_KEY} AS url_key FROM (
    SELECT page_id, {_STEP},
      CASE WHEN page_id % 7 = 1 THEN NULL WHEN page_id % 5 = 0 THEN '"stale"' ELSE '"' || md5(html) || '"' END AS tag,
      CASE WHEN page_id % 7 = 1 AND page_id % 11 = 2 THEN NULL ELSE 'day ' || (page_id % 28) END AS day
    FROM pages)),
met AS (
  SELECT v.page_id AS v, v.url_key, r.page_id AS r, r.html, r.tag AS stored, r.day AS stored_day,
    CASE WHEN v.tag IS NOT NULL THEN v.tag = r.tag ELSE v.day = r.day END AS same
  FROM revisits v ASOF LEFT JOIN responses r ON v.url_key = r.url_key AND v.page_id >= r.page_id)
SELECT 'v' || v AS record_id, url_key,
  CASE WHEN r IS NULL THEN 'missing' WHEN same THEN 'resolved' WHEN same IS NULL THEN 'unverified' ELSE 'changed' END AS outcome,
  'r' || r AS source_id,
  CASE WHEN same THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || length(html) || chr(10) ||
    'content-type: text/html' || chr(10) || 'date: ' || stored_day || chr(10) || 'etag: ' || stored || chr(10) || 'x-cache: hit' END AS headers,
  CASE WHEN same THEN sha256(html) END AS payload_sha256
FROM met
"""


def components_sql(percent: int, prefix: str = "WITH RECURSIVE", documents: str = "documents") -> str:
    """Common tables: ``component`` (doc_id, n_shingles, component_id) of the documents."""
    words = _WORDS.format(_LOWER.format("text"))
    return f"""
{prefix} jwords AS (SELECT doc_id, {words} AS w FROM {documents}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM jwords),
each_shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM each_shingle a JOIN each_shingle b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= {percent} * (nx + ny - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM {documents} UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s)
"""


OP2 = components_sql(90) + "SELECT * FROM component"

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP6 = r"""
WITH RECURSIVE said AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations),
keyed AS (
  SELECT *, trim(text) AS own, nullif(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '') AS key,
    row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, md5(text)) AS t FROM said),
least AS (SELECT conv_id, turn, min(text) AS text FROM said GROUP BY conv_id, turn),
asks AS (
  SELECT a.t, k AS level, b.key FROM keyed a JOIN (SELECT unnest([1, 2]) AS k) ON true
  JOIN least l ON l.conv_id = a.conv_id AND l.turn = a.turn - k
  JOIN keyed b ON b.conv_id = l.conv_id AND b.turn = l.turn AND b.text = l.text),
met AS (SELECT a.t, a.level, b.t AS parent FROM asks a ASOF JOIN keyed b ON a.key = b.key AND a.t > b.t),
up AS (SELECT t, arg_min(parent, level) AS parent FROM met GROUP BY t),
tree AS (
  SELECT k.t, k.t AS root, 0 AS depth, NULL::BIGINT AS parent FROM keyed k LEFT JOIN up u ON u.t = k.t WHERE u.parent IS NULL
  UNION ALL SELECT u.t, r.root, r.depth + 1, u.parent FROM up u JOIN tree r ON u.parent = r.t),
named AS (
  SELECT *, coalesce(conv_id::VARCHAR, 'none') || '-' || coalesce(turn::VARCHAR, 'none') || '-' || md5(text) AS msg_id FROM keyed)
SELECT r.msg_id AS thread_id, row_number() OVER (PARTITION BY x.root ORDER BY x.t) - 1 AS position, m.msg_id,
  p.msg_id AS parent_id, x.depth::BIGINT AS depth, m.own AS text
FROM tree x JOIN named m ON m.t = x.t JOIN named r ON r.t = x.root LEFT JOIN named p ON p.t = x.parent
"""


def dedup_sql(prefix: str = "WITH", documents: str = "documents") -> str:
    """Common tables: ``kept`` (doc_id, n_words, n_removed, kept) of the documents."""
    words = _WORDS.format("text")
    return f"""
{prefix} words AS (SELECT doc_id, {words} AS w FROM {documents}),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: hash(array_to_string(w[i:i+19], ' ')))) AS h,
    unnest(range(1, len(w) - 18)) AS i FROM words),
gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM (
    SELECT doc_id, i, unnest(range(0, 20)) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1)),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept_words AS (
  SELECT e.doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed,
    coalesce(string_agg(e.word, ' ' ORDER BY e.j) FILTER (g.j IS NULL), '') AS kept
  FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id),
kept AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.kept, '') AS kept
  FROM words w LEFT JOIN kept_words k ON k.doc_id = w.doc_id)
"""


OP9 = dedup_sql() + "SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept"

# Unsigned CRC-32 of an ASCII string, a bit at a time; 3988292384 is the reversed polynomial (a fixed value).
_CRC32 = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


OP11 = f"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w, {_CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
shaped AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM read),
looped AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + (h // 10) % 8))])) END AS w
  FROM shaped),
each AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM looped),
met AS (SELECT x.r, y.i, y.i - x.i AS q FROM each x JOIN each y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT r, q, min(i) - q AS start, count(*) + q AS length FROM (
    SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM met)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.r = s.r AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
  SELECT e.r, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = e.r AND g.i = e.i) GROUP BY e.r),
best AS (
  SELECT r, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'q': q}}, (-length, start, q)) AS b,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS shown FROM runs GROUP BY r)
SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM looped l LEFT JOIN best USING (r) LEFT JOIN kept k USING (r)
"""

OP12 = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, coalesce(doc_id, -9223372036854775808) AS doc_id, i, line,
    {_LOWER.format("regexp_replace(line, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g')")} AS key
  FROM (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM split)),
repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, coalesce(p.last <> l.doc_id, false) AS gone FROM lines l LEFT JOIN repeated p ON p.key = l.key)
SELECT any_value(s.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked m JOIN split s ON s.r = m.r GROUP BY m.r
"""


def _leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


def _tree(name: str, base: str) -> str:
    """Common tables ``name`` (tree, level, i, n, d) of all nodes of the trees whose leaves ``base`` holds."""
    return f"""
{name}(tree, level, i, n, d) AS (
  SELECT tree, 0, i, n, d FROM {base}
  UNION ALL
  SELECT tree, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2)"""


def _fold(name: str, tree: str, base: str) -> str:
    return f"""
{name}(id, tree, level, i, d, proof) AS (
  SELECT id, tree, 0, i, d, proof FROM {base}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.i // 2,
    sha256(CASE WHEN f.i % 2 = 0 THEN f.d || coalesce(s.d, '') ELSE s.d || f.d END), f.proof || coalesce(s.d, '')
  FROM {name} f JOIN {tree} o ON o.tree IS NOT DISTINCT FROM f.tree AND o.level = f.level AND o.i = f.i AND o.n > 1
  LEFT JOIN {tree} s ON s.tree IS NOT DISTINCT FROM f.tree AND s.level = f.level AND s.i = xor(f.i, 1))"""


OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER () AS id
  FROM (SELECT doc_id, lang AS tree, {_leaf("n_chars")} AS d,
    CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS tampered FROM documents)),
{_tree("low", "leaves")},
subroots AS (
  SELECT tree AS lang, d, true AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM low WHERE n = 1),
{_tree("top", "subroots")},
asks AS (SELECT id, tree, i, coalesce(tampered, d) AS d, '' AS proof FROM leaves),
{_fold("climb", "low", "asks")},
mid AS (
  SELECT c.id, true AS tree, s.i, c.d, c.proof FROM climb c
  JOIN low o ON o.tree IS NOT DISTINCT FROM c.tree AND o.level = c.level AND o.i = c.i AND o.n = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.tree),
{_fold("last", "top", "mid")},
done AS (SELECT c.id, c.d, c.proof FROM last c JOIN top o ON o.level = c.level AND o.i = c.i AND o.n = 1)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM leaves l JOIN done f ON f.id = l.id JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.tree JOIN top r ON r.n = 1
"""

ORACLE = {
    "op1_revisits": OP1,
    "op2_jaccard_join": OP2,
    "op3_topk_search": OP3,
    "op6_quotes": OP6,
    "op9_substring_dedup": OP9,
    "op11_periodic_runs": OP11,
    "op12_line_dedup": OP12,
    "op13_merkle_manifest": OP13,
}
