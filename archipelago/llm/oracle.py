"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written from the definitions; the other operators are tested against
brute-force versions, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from archipelago.llm.quality_rules import ALPHA, DELTA, GRID, settings

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, step.b FROM reach JOIN step ON step.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

OP4 = r"""
WITH part AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM part),
rule(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS nth
        FROM cut LEFT JOIN rule ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM fit WHERE nth = 1
"""

_SETTINGS = ", ".join(f"({which}, {step}, {', '.join(str(cut.get(rule, 'NULL::DOUBLE')) for rule in GRID)})" for which, step, cut in settings())
_RATES = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "shout_share": "n_shouted / greatest(n_words, 1)"}


def quality_rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM documents),
runs AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS k FROM runs) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, range(0, 5) t(d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(text, '\p{{Lu}}{{2,}}[^\x20\x09-\x0D]*')) AS n_shouted FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
r AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _RATES.items())} FROM f),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
setting(which, step, {", ".join(f"cut_{x}" for x in GRID)}) AS (VALUES {_SETTINGS}),
held AS (SELECT lang, good, which, step, {" OR ".join(f"coalesce({x} >= cut_{x}, false)" for x in GRID)} AS hit FROM r JOIN lab USING (doc_id), setting WHERE NOT base_failed),
counts AS (SELECT lang, which, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS caught FROM held GROUP BY ALL),
level AS (SELECT {delta} / ({2 ** len(GRID) - 1} * count(*)) AS level FROM (SELECT DISTINCT lang FROM counts WHERE n > 0)),
sure AS (
  SELECT counts.* FROM counts, level WHERE caught > 0 AND k <= n * {alpha}
  AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})) FOR i IN range(0, k + 1)]) <= level),
best AS (SELECT lang, which, step FROM sure QUALIFY row_number() OVER (PARTITION BY lang ORDER BY caught DESC, k, step DESC, which) = 1),
chosen AS (SELECT lang, {", ".join(f"cut_{x}" for x in GRID)} FROM best JOIN setting USING (which, step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, rejected_by FROM (
  SELECT r.*, CASE WHEN base_failed THEN NULL {" ".join(f"WHEN {x} >= cut_{x} THEN '{x}'" for x in GRID)} END AS rejected_by FROM r LEFT JOIN chosen ON chosen.lang IS NOT DISTINCT FROM r.lang)
"""


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9 = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, list_aggregate(w[s:s + size - 1], 'string_agg', ' ') AS run FROM (
  SELECT item, w, least(13, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({LOW}, {_ALNUM}) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, size, s, list_aggregate(w[s:s + size - 1], 'string_agg', ' ') AS run FROM (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, s, size, item FROM runs JOIN win USING (size, run)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# the table of the reflected CRC-32 polynomial, and the CRC of a list of bytes
CRC_TABLE = "list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v::BIGINT))"


def crc(bytes_: str) -> str:
    """SQL for the CRC of the bytes of the list ``bytes_``; ``tab`` is its table."""
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP11 = rf"""
WITH t AS (SELECT {CRC_TABLE} AS tab),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) AS k, r, x
        FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc("list_transform(string_split(conv_id::VARCHAR, ''), lambda q: ord(q)::BIGINT)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own), t),
made AS (SELECT c.conv_id, 0 AS part, k, r, x FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
         UNION ALL SELECT c.conv_id, 1, k, r, x FROM c JOIN own ON own.conv_id = c.conv_id AND k > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, r, x FROM made),
b AS (SELECT conv_id, d, x, list({{'r': r, 'x': x}}) OVER (PARTITION BY conv_id ORDER BY d) AS p FROM turns
      UNION ALL SELECT conv_id, 0, '', [] FROM c),
b2 AS (SELECT *, p[:-2] AS q, d = max(d) OVER (PARTITION BY conv_id) AS ended FROM b),
node AS (SELECT p, any_value(q) AS q, d, min(conv_id) AS conv_id, count(*) AS n, any_value(len(regexp_extract_all(x, {WORD}))) AS words,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM b2 GROUP BY p, d),
kids AS (SELECT q, count(*) AS k FROM node WHERE d > 0 GROUP BY q),
n2 AS (SELECT node.*, coalesce(kids.k, 0) AS k FROM node LEFT JOIN kids ON kids.q = node.p),
sub AS (SELECT a.p, count(*) FILTER (x.k = 0) AS leaves, sum((x.n - 1) * x.words) AS saved FROM n2 a JOIN n2 x ON x.p[:a.d] = a.p AND x.d >= a.d GROUP BY a.p)
SELECT a.conv_id, a.d AS depth, CASE WHEN a.d > 0 THEN up.conv_id END AS parent_conv_id, a.n AS n_convs, a.k AS n_children, sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens,
       sha256(a.ends) AS ends_sha256, CASE WHEN a.ends = '' THEN 0 ELSE len(string_split(a.ends, ',')) END AS n_ends
FROM n2 a JOIN sub ON sub.p = a.p LEFT JOIN n2 up ON up.p = a.q AND a.d > 0
"""


OP13 = rf"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS tab),
w AS (SELECT id, w, count(*) AS k FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOW}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, k, {crc("flatten(list_transform(string_split(id || ':' || w, ''), lambda q: CASE WHEN ord(q) < 128 THEN [ord(q)::BIGINT] ELSE [195::BIGINT, ord(q)::BIGINT - 64] END))")} AS h FROM w, t),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
d AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM d)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN d b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN d b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
f AS (SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * d.n THEN near END AS form, CASE WHEN near_n >= 10 * d.n THEN near_n END AS form_n FROM d LEFT JOIN best USING (word)),
up(word, top) AS (SELECT word, word FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.top AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f e ON e.word = up.top WHERE e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": OP3, "op4_url_filter": OP4, "op7_quality_rules": quality_rules_sql(), "op9_decontamination": OP9, "op11_conversation_trie": OP11, "op13_spelling_variants": OP13}
