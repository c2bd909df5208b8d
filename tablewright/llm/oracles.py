"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import re

from .common import tokenizer_path
from .line_dedup import WORDS
from .secret_scan import BASE, RULES
from .source_mixing import BUDGET, MOST, SLICE, WEIGHTS

#: The vocabulary of op4.
TOKENS = "byte_bpe_50k.tiktoken"

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Structs (start, rank, kind, end) of a rule's matches: their places follow from what is between them."""
    # (?i) folds more letters than A to Z here, so both cases are spelt out
    quoted = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern).replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda i: {{
        's': CAST(coalesce(list_sum(list_transform(string_split_regex(t, '{quoted}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        'r': {rank}, 'k': '{kind}', 'n': length(regexp_extract_all(t, '{quoted}')[i]), 'g': length(regexp_extract_all(t, '{quoted}', {group})[i])}}), lambda m: m.g >= {least})"""


def _told(spans: str) -> str:
    return f"array_to_string(list_transform(list_sort({spans}), lambda m: concat(m.k, ':', m.s, ':', m.s + m.n)), ',')"


_LISTS = ", ".join(f"{_spans(r.kind, n, r.pattern, r.group, r.least)} AS {r.kind}_" for n, r in enumerate(RULES))
_BASE = "list_concat(list_concat(assign_, access_), hex_)"

_GAP = r"[ \t\n\x0b\f\r]"
_WORD = r"[^ \t\n\x0b\f\r]+"
LINES = f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST) AS place FROM documents),
t AS (SELECT place, unnest(x) AS tok, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT place, regexp_extract_all(text, '{_WORD}{_GAP}*') AS x FROM d)),
w AS (SELECT *, regexp_extract(tok, '^{_WORD}') AS word, contains(tok, chr(10)) AS feed FROM t),
m AS (SELECT *, coalesce(sum(CASE WHEN feed OR right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM w),
l AS (SELECT place, line, string_agg(word, ' ' ORDER BY i) AS content, min(i) - 1 AS b, max(i) AS e FROM m GROUP BY place, line),
forth AS (SELECT a.place, a.line AS first, z.line AS last FROM (SELECT *, b + {WORDS} AS least FROM l) a ASOF JOIN l z ON a.place = z.place AND a.least <= z.e),
back AS (SELECT z.place, a.line AS first, z.line AS last FROM (SELECT *, e - {WORDS} AS most FROM l) z ASOF JOIN l a ON a.place = z.place AND z.most >= a.b),
c AS (SELECT place, list(content ORDER BY line) AS x FROM l GROUP BY place),
v AS (SELECT s.place, s.first, s.last, md5(array_to_string(x[CAST(s.first AS INT) + 1:CAST(s.last AS INT) + 1], chr(10))) AS run FROM (SELECT * FROM forth UNION SELECT * FROM back) s JOIN c USING (place)),
r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY run ORDER BY place, first) > 1),
gone AS (SELECT DISTINCT l.place, l.line FROM l JOIN r ON l.place = r.place AND l.line BETWEEN r.first AND r.last),
k AS (SELECT m.*, gone.line IS NOT NULL AS cut FROM m LEFT JOIN gone ON m.place = gone.place AND m.line = gone.line),
f AS (SELECT *, lead(cut) OVER (PARTITION BY place ORDER BY i) AS cut_next, last_value(CASE WHEN NOT cut THEN feed END IGNORE NULLS) OVER (PARTITION BY place ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fed FROM k),
o AS (SELECT place, string_agg(CASE WHEN NOT cut THEN tok WHEN feed AND NOT cut_next AND NOT fed THEN chr(10) ELSE '' END, '' ORDER BY i) AS body, bool_or(cut AND i = 1) AS head, bool_or(cut AND i = n) AS tail, count(*) AS n_words, count(*) FILTER (WHERE cut) AS n_removed FROM f GROUP BY place)
SELECT doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE (CASE WHEN tail THEN regexp_replace(u, '{_GAP}+$', '') ELSE u END) END AS text, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed
FROM (SELECT d.doc_id, d.text, o.*, (CASE WHEN head THEN '' ELSE regexp_extract(text, '^{_GAP}*') END) || body AS u FROM d LEFT JOIN o USING (place))
"""

#: A vocabulary's tokens as hexadecimal digits; of each place in each word the longest token; then from token to token.
COUNTS = f"""
WITH RECURSIVE v AS (SELECT hex(from_base64(split_part(line, ' ', 1))) AS h FROM read_csv('{tokenizer_path(TOKENS)}', columns = {{'line': 'VARCHAR'}}, header = FALSE, delim = '\\x01', quote = '', escape = '')),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM documents),
u AS (SELECT w, hex(encode(' ' || w)) AS h FROM (SELECT DISTINCT w FROM w)),
x AS (SELECT left(h, 6) AS a, max(length(h) // 2) AS most FROM v WHERE length(h) >= 6 GROUP BY 1),
p AS (SELECT w, h, unnest(range(length(h) // 2)) AS pos FROM u),
r AS (SELECT w, pos, substr(h, 2 * pos + 1, 2 * coalesce(most, 2)) AS h FROM p LEFT JOIN x ON a = substr(h, 2 * pos + 1, 6)),
m AS (SELECT w, pos, max(length(v.h) // 2) AS n FROM (SELECT w, pos, unnest(list_transform(range(1, length(h) // 2 + 1), lambda k: left(h, 2 * k))) AS h FROM r) q JOIN v ON q.h = v.h GROUP BY w, pos),
g AS (SELECT w, CAST(0 AS BIGINT) AS pos, 0 AS n, length(h) // 2 AS size FROM u UNION ALL SELECT g.w, g.pos + m.n, g.n + 1, g.size FROM g JOIN m ON g.w = m.w AND g.pos = m.pos),
c AS (SELECT w, coalesce(max(CASE WHEN pos = size THEN n END), 1) AS n FROM g GROUP BY w)
SELECT d.doc_id, count(w.w) AS n_words, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN c ON w.w = c.w GROUP BY d.doc_id
"""

_CYCLE = f"[{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT) + 1]"
MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST({_CYCLE} AS DOUBLE) AS w, CAST({MOST} * source_size AS DOUBLE) AS most FROM s),
r AS (SELECT *, most / w AS r FROM w),
v AS (SELECT *, (CAST({BUDGET} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, coalesce(least(most, max(CASE WHEN level <= r THEN level END) OVER () * w), most) AS target FROM v),
q AS (SELECT d.*, source_size, target, md5(concat(k, ':', o)) AS h, k FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest(range({MOST})) AS k) WHERE size > 0),
t AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, left(h, {SLICE}), h) AS DOUBLE) / target AS finish FROM q),
x AS (SELECT o, CAST(sum(size) AS BIGINT) AS taken FROM (SELECT *, sum(size) OVER (ORDER BY finish, h) AS run FROM t) WHERE run <= (SELECT round(sum(target), 6) FROM g) GROUP BY o)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x USING (o)
"""

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {_LISTS} FROM d)
SELECT doc_id, {', '.join(f'len({r.kind}_) AS n_{r.kind}' for r in BASE)}, sha256({_told(_BASE)}) AS base_sha256,
    {_told(f'list_concat(list_concat({_BASE}, pem_), jwt_)')} AS spans FROM f
"""
