"""DuckDB SQL that gives the rows of op2, op5 and op7 by plain joins and windows, without the operators' methods."""

from __future__ import annotations

from textloom.llm import near_dedup, quality, suffix_dedup

_SPACE = r"\x20\x09-\x0D"


def suffix_dedup_sql(length: int = suffix_dedup.LENGTH, words: int = suffix_dedup.PASSAGE_WORDS) -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, pos, md5(substr(h, 2 * pos + 1, {2 * length})) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - {length - 1})) AS pos FROM d)),
rep AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
runs AS (SELECT r, min(pos) AS a, max(pos) + {length} AS b FROM (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS i FROM (
SELECT r, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY r ORDER BY pos) + {length} THEN 1 ELSE 0 END AS new FROM rep)) GROUP BY r, i),
cut AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last FROM (
SELECT r, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (SELECT runs.*, d.h, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs JOIN d USING (r))) GROUP BY r),
x AS (SELECT r, unnest(ws) AS w, unnest(gs[:len(ws)]) AS g, unnest(range(len(ws))) AS i, len(ws) AS n FROM (SELECT r, regexp_extract_all(text, '[^{_SPACE}]+') AS ws, regexp_split_to_array(text, '[^{_SPACE}]+') AS gs FROM d)),
p AS (SELECT r, i, n, strlen(w) AS size, sum(strlen(g) + strlen(w)) OVER (PARTITION BY r ORDER BY i) AS e, md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)) AS k FROM x),
wrep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM p WHERE i <= n - {words}) WHERE c > 1),
wruns AS (SELECT r, min(i) AS a, max(i) + {words} - 1 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (
SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {words} THEN 1 ELSE 0 END AS new FROM wrep)) GROUP BY r, g),
said AS (SELECT u.r, sum(z.e - (s.e - s.size))::BIGINT AS n_passage_bytes FROM wruns u JOIN p s ON s.r = u.r AND s.i = u.a JOIN p z ON z.r = u.r AND z.i = u.b GROUP BY u.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passage_bytes, 0) AS n_passage_bytes
FROM d LEFT JOIN cut USING (r) LEFT JOIN said USING (r)"""


def near_dedup_sql(width: int = near_dedup.SHINGLE, percent: int = near_dedup.PERCENT) -> str:
    upper = "".join(chr(65 + i) for i in range(26))
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^{_SPACE}]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= {width} THEN list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS root FROM n UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(root) AS root FROM reach GROUP BY a) c ON c.a = d.doc_id"""


def quality_sql() -> str:
    q, width = quality, max(map(len, quality.COMMON.values()))
    quoted = lambda words: "[" + ", ".join(f"' {w} '" for w in words) + "]"
    lists = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in q.COMMON.items())
    chain = ["solid"]
    steps = []
    for i, pattern in enumerate(("[a-z]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"\p{L}+")):
        steps.append(f"regexp_replace({chain[-1]}, '{pattern}', '', 'g') AS rest{i}")
        chain.append(f"rest{i}")
    classes = ", ".join(f"(length({a}) - length({b}))::DOUBLE" for a, b in zip(chain, chain[1:])) + f", length({chain[-1]})::DOUBLE"
    term = lambda p, o: f"CASE WHEN x.{p} > 0 THEN x.{p} * log2(2 * x.{p} / (x.{p} + x.{o})) ELSE 0 END"
    distance = lambda name: f"sqrt(greatest(0, list_sum(list_transform(list_zip({name}, q_{name}), lambda v: struct_pack(p := v[1], q := v[2])).list_transform(lambda x: ({term('p', 'q')} + {term('q', 'p')}) / 2))))"
    mean = lambda name, when: f"SELECT key, list(m ORDER BY i) AS q_{name} FROM (SELECT key, i, avg(v) AS m FROM (SELECT key, unnest({name}) AS v, unnest(range(len({name}))) AS i FROM f WHERE {when}) GROUP BY ALL) GROUP BY key"
    return rf"""WITH a AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({', '.join(f"'{k}'" for k in q.COMMON)}) THEN lang ELSE 'other' END AS key, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x09-\x0D]', ' ', 'g') AS spaced FROM documents),
b AS (SELECT *, replace(spaced, ' ', '') AS solid, list_filter(string_split(spaced, ' '), lambda x: x <> '') AS ws, ' ' || replace(lower(spaced), ' ', '  ') || ' ' AS padded FROM a),
c AS (SELECT *, {', '.join(steps)} FROM b),
g AS (SELECT *, [{classes}] AS counts, CASE WHEN key = 'other' THEN list_transform(range({width}), lambda i: 0.0::DOUBLE) ELSE list_transform(CASE key {lists} END, lambda w: ((strlen(padded) - strlen(replace(padded, w, ''))) / strlen(w))::DOUBLE) END AS hits FROM c),
f AS (SELECT *, len(ws) AS n_words, list_transform(counts, lambda x: x / greatest(1, length(solid))) AS class, list_transform(list_append(hits, greatest(0, len(ws) - list_sum(hits))), lambda x: x / greatest(1, len(ws))) AS common FROM g),
qa AS ({mean('class', f'length(solid) >= {q.MIN_CHARS_CLASS}')}), qb AS ({mean('common', f'n_words >= {q.MIN_WORDS_COMMON}')}),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, unnest(range(n_words - {q.WINDOW - 1})) AS i, unnest(list_transform(range(1, n_words - {q.WINDOW - 2}), lambda i: array_to_string(ws[i:i + {q.WINDOW - 1}], ' '))) AS k FROM f WHERE n_words >= {q.WINDOW})),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {q.WINDOW})) AS j FROM win WHERE c > 1) GROUP BY r),
m AS (SELECT f.*, coalesce(rep.n, 0) AS n_repeat_words, length(solid) AS word_chars, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines,
round(CASE WHEN length(solid) >= {q.MIN_CHARS_CLASS} THEN {distance('class')} ELSE 0 END, 6) AS js_class, round(CASE WHEN n_words >= {q.MIN_WORDS_COMMON} AND key <> 'other' THEN {distance('common')} ELSE 0 END, 6) AS js_common
FROM f LEFT JOIN rep USING (r) LEFT JOIN qa USING (key) LEFT JOIN qb USING (key))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words AS base_failed, js_class, js_common, NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words) AND js_class <= {q.MAX_CLASS} AND js_common <= {q.MAX_COMMON} AS kept FROM m"""
