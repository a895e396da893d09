"""SQL with the results of the queries that it can express, over whole tables."""

from .license_scan import PHRASES, TEMPLATES
from .url_filter import MARKS, RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COMPONENTS = """
reached(v, w) AS (SELECT a, b FROM links UNION SELECT r.v, l.b FROM reached r JOIN links l ON r.w = l.a),
comp AS (SELECT v, least(v, min(w)) AS comp FROM reached GROUP BY v)
"""

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * overlap >= 75 * (x.n + y.n - overlap)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.comp, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.v = d.doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.comp, v.vec_id) AS component_id, coalesce(comp.comp, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.v = v.vec_id
"""

_rules = "\n".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for r in sorted(RULES, key=len, reverse=True)
)
_verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
OP2 = f"""
WITH s AS (SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '')")} AS host,
           coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages),
r AS (SELECT *, CASE {_rules} END AS rule, CASE WHEN host <> '' THEN host || rtrim(path, '/') END AS key FROM s),
listed AS (SELECT DISTINCT key FROM r WHERE 50 * len(regexp_extract_all(html, '{MARKS}')) >= length(html) AND key IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(CASE rule {_verdicts} END, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       listed.key IS NOT NULL AS listed
FROM r LEFT JOIN listed ON listed.key = r.key
"""

_word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_phrases = ", ".join(f"(['{chr(39).join([p.replace(' ', chr(39) + ', ' + chr(39))])}'], '{label}')" for p, label in PHRASES.items())
_templates = ", ".join(f"('{label}', {len(t.split())}, list_distinct(string_split('{t}', ' ')))" for label, t in TEMPLATES)
OP7 = f"""
WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, {_word}) AS ws FROM t),
phrases(p, label) AS (VALUES {_phrases}),
hits AS (SELECT doc_id, i - 1 AS spot, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN phrases ON ws[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list_sort(list_distinct(list(label))) AS labels FROM hits GROUP BY doc_id),
templates(label, n, own) AS (VALUES {_templates}),
blocks AS (SELECT doc_id, label, own, list_intersect(list_distinct(ws[j * n + 1:j * n + 2 * n]), own) AS held
           FROM (SELECT doc_id, ws, label, n, own, unnest(range(0, (len(ws) + n - 1) // n)) AS j FROM w, templates)),
more AS (SELECT doc_id, label, len(held) / len(own) AS share FROM blocks WHERE len(held) >= 0.8 * len(own)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM more GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, i AS base, substring(h, 2 * i + 1, 2 * 1199) AS h FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 1000)) AS i FROM d)),
w AS (SELECT r, base + k AS a, md5(substring(h, 2 * k + 1, 400)) AS g FROM (SELECT r, base, h, unnest(range(0, least(len(h) // 2 - 199, 1000))) AS k FROM c)),
hot AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT r, a, coalesce(a - lag(a) OVER o > 200, true) AS fresh FROM w JOIN hot USING (g) WINDOW o AS (PARTITION BY r ORDER BY a)),
n AS (SELECT r, a, sum(fresh::INT) OVER (PARTITION BY r ORDER BY a) AS k FROM s),
spans AS (SELECT r, k, min(a) AS lo, max(a) + 200 AS hi FROM n GROUP BY r, k),
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM spans),
t AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(d.h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head, max(hi) AS fin
      FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(fin, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

# A backslash goes before each backslash, each # that begins ### and each < that begins </turn>; in a role also before : and line feeds.
_marks = "(len({0}) - len(replace({0}, '\\', '')) + list_sum(list_transform(regexp_extract_all({0}, '#+'), lambda x: greatest(len(x) - 2, 0))) + len(regexp_extract_all({0}, '</turn>')))"
_marks = f"coalesce({_marks}, len({{0}}) - len(replace({{0}}, '\\', '')) + len(regexp_extract_all({{0}}, '</turn>')))"
_more = "len(regexp_extract_all(role, '[:\\n]'))"
OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
f AS (SELECT *, 4 + len(role) + {_marks.format("role")} + {_more} + 2 + len(text) + {_marks.format("text")} + 8 AS formatted FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(formatted) AS formatted FROM f GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM c
"""

OP11 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, {LOWER.format("trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
common AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT doc_id, i, line, coalesce(last <> doc_id, false) AS gone FROM l LEFT JOIN common USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

# CRC-32 of the UTF-8 bytes of {0}, whose table of 256 values is made by its rule.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len({0}), 2), lambda i: ('0x' || substr({0}, i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT)"

_leaf = "sha256(" + " || ".join(f"coalesce(strlen({{{k}}}::VARCHAR) || ':' || {{{k}}}::VARCHAR, '-')" for k in range(5)) + ")"
_tampered = f"CASE WHEN {CRC.format('h')} % 3 = 0 THEN {LOWER.format('text')} ELSE text END"


def merkle_levels(trees: str, runs: str, nodes: str) -> str:
    """Common tables of the levels of trees(tree, k, n, d): a recursion over levels, then runs of siblings by level."""
    return f"""
{nodes} AS (SELECT tree, 0 AS lv, k, n, d FROM {trees} UNION ALL
  SELECT tree, lv + 1, k // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY k)) FROM {nodes} WHERE n > 1 GROUP BY tree, lv, k // 8),
{runs} AS (SELECT tree, lv, k // 8 AS run, list(d ORDER BY k) AS ds FROM {nodes} WHERE n > 1 GROUP BY tree, lv, k // 8)"""


def merkle_proofs(trees: str, runs: str) -> str:
    return f"""
SELECT t.tree, t.k, list({{'l': r.ds[1:(t.k // (8 ** r.lv)::BIGINT) % 8], 'r': r.ds[(t.k // (8 ** r.lv)::BIGINT) % 8 + 2:]}} ORDER BY r.lv) AS steps
FROM {trees} t JOIN {runs} r ON r.tree = t.tree AND r.run = t.k // (8 ** (r.lv + 1))::BIGINT GROUP BY t.tree, t.k"""


OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, lang, {_leaf.format("doc_id", "source", "lang", "n_chars", "text")} AS d, {_leaf.format("doc_id", "source", "lang", "n_chars", f"({_tampered})")} AS claim
      FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS h FROM documents), crc),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM d GROUP BY lang),
leaves AS (SELECT g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, d) - 1 AS k, n, d, claim, doc_id FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang),
{merkle_levels("leaves", "runs", "nodes")},
subroots AS (SELECT 0 AS tree, tree AS k, (SELECT count(*) FROM g) AS n, d FROM nodes WHERE n = 1),
{merkle_levels("subroots", "top_runs", "tops")},
below AS ({merkle_proofs("leaves", "runs")}),
above AS ({merkle_proofs("subroots", "top_runs")}),
p AS (SELECT doc_id, l.d AS leaf, claim, s.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, list_concat(b.steps, a.steps) AS steps
      FROM leaves l JOIN subroots s ON s.k = l.tree LEFT JOIN below b ON b.tree = l.tree AND b.k = l.k LEFT JOIN above a ON a.k = l.tree),
f AS (SELECT *, list_reduce(list_concat([{{'l': [claim], 'r': []::VARCHAR[]}}], steps), lambda a, x: {{'l': [sha256(array_to_string(list_concat(x.l, a.l, x.r), ''))], 'r': []::VARCHAR[]}}).l[1] AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flatten(list_transform(steps, lambda x: list_concat(x.l, x.r))), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f
"""

OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, n, {CRC.format("h")} AS h FROM (SELECT w, n, hex(encode(doc_id::VARCHAR || ':' || w)) AS h FROM r), crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (SELECT word AS a, rest AS b FROM cuts WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM words)
          UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words ON word = b),
f AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN b END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
      FROM words LEFT JOIN best ON a = word AND k = 1),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f g ON g.word = up.root WHERE g.form IS NULL
"""

ORACLES = {"op6_suffix_dedup": OP6, "op10_chat_format": OP10, "op11_line_dedup": OP11, "op13_merkle_manifest": OP13, "op12_spelling_variants": OP12, "op1_ngram_jaccard_join": OP1, "op2_url_filter": OP2, "op3_embedding_dedup": OP3, "op7_license_scan": OP7}
