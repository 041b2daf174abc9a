"""DuckDB text of the registered queries that SQL can express."""

from .license_scan import NOT_HOLDERS, SPELLINGS, TITLES, all_texts
from .quality import RULES, STOP_WORDS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    states = rf"""regexp_matches(lower(l), '^[ \t]*(copyright[ \t]*(\(c\)|©)|©|(copyright|\(c\))[ \t:]+([0-9][0-9][0-9][0-9]|[<\[]?(year|yyyy)))')
      OR regexp_matches(l, '^[ \t]*(?i:copyright)[ \t]+\p{{Lu}}') AND NOT regexp_matches(lower(l), '^[ \t]*copyright[ \t]+({NOT_HOLDERS})([^\p{{L}}\p{{N}}]|$)')
      OR i = 1 AND regexp_matches(lower(l), '^[ \t]*\(c\)')
      OR regexp_matches(lower(l), '^[ \t]*all rights reserved[.]?[ \t]*$')"""
    out = rf"lower(array_to_string(list_filter(string_split({column}, chr(10)), lambda l, i: NOT ({states})), chr(10)))"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"regexp_replace({out}, '^({'|'.join(TITLES)}) ', '')"


OP1 = f"""
WITH known AS (
  SELECT sha256({_canonical("t")}) AS dig, min(id) AS id
  FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in all_texts())}) AS v(id, t) GROUP BY 1),
d AS (SELECT doc_id, {_canonical("text")} AS c, text FROM documents),
lines AS (SELECT doc_id, {_canonical("line")} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(DISTINCT id) AS n
  FROM lines JOIN known ON sha256(lines.c) = known.dig WHERE lines.c <> '' GROUP BY 1)
SELECT d.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_digest, k.id AS license_id,
  coalesce(f.notices, '') AS notices, coalesce(f.n, 0)::BIGINT AS n_notices
FROM d LEFT JOIN known k ON c <> '' AND sha256(c) = k.dig LEFT JOIN found f ON f.doc_id = d.doc_id
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _rule(r) -> str:
    value = f"({r.numerator}::DOUBLE)" if not r.denominator else f"(CASE WHEN {r.denominator} > 0 THEN {r.numerator}::DOUBLE / {r.denominator} END)"
    bounds = ((">=", r.least), ("<=", r.most))
    tests = [f"{value} {sign} {float(bound)}" for sign, bound in bounds if bound is not None]
    return f"(n_words < {r.from_words} OR coalesce({' AND '.join(tests)}, true))"


OP4 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g FROM a WHERE len(w) >= 5),
u AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM g),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM u),
x AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c WHERE n > 1),
p AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n_repeat_words FROM x GROUP BY 1),
m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaimed,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis_lines,
  len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
  len(list_filter(w, lambda x: list_contains([{", ".join(map(_quoted, STOP_WORDS))}], lower(x)))) AS n_stop_words,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept FROM b
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS dig FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY dig) AS first_id FROM q)
SELECT page_id, n AS payload_bytes, dig AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""

OP8 = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
  sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS ws FROM w),
z AS (SELECT filled AS f0, ws AS w0 FROM l WHERE w * (total - filled) / ws <= cap ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f0 IS NULL OR cap < w * (total - f0) / w0 THEN cap::DOUBLE ELSE w * (total - f0) / w0 END AS target FROM l LEFT JOIN z ON true),
c AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id::VARCHAR), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * whole + least(size, greatest(0, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken FROM c
"""

OP11 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT r, vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = b GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""

_TERMS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
OP12 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS a FROM documents),
g AS (SELECT count(*) FILTER (len(a) > 0)::BIGINT AS n, sum(len(a))::BIGINT AS l FROM t),
p AS (SELECT r, doc_id, len(a)::BIGINT AS n, term, count(*) AS tf FROM (SELECT r, doc_id, a, unnest(a) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * g.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, g.n),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * g.n) // g.l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def _repair_steps() -> dict[int, list[str]]:
    """For each grammar state, the ways into it over one row: up to two insertions from another, then an edit."""
    then = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    before = {0: [(0, ""), (2, "I"), (3, "II")], 1: [(1, ""), (2, "I"), (3, "II")], 2: [(2, ""), (3, "I")], 3: [(3, ""), (2, "I")]}
    out: dict[int, list[str]] = {g: [] for g in range(4)}
    add = lambda g, cost, labels: f"(lpad((substr(w{g}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr(w{g}, 13) || '{labels}')"
    for g, ways in before.items():
        for m, ins in ways:
            out[m].append(add(g, 3 * len(ins) + 4, ins + "D"))
            for (a, initial), h in then.items():
                if a == m:
                    out[h].append(f"CASE WHEN NOT must_go AND ini = '{initial}' THEN {add(g, f'{3 * len(ins)} + 3 * cut', ins + 'K')} END")
                    if initial != "s":
                        out[h].append(f"CASE WHEN NOT must_go THEN {add(g, f'{3 * len(ins)} + 3 + 3 * cut', ins + 'R')} END")
    return out


_STEPS = ", ".join(f"least({', '.join(ways)})" for _, ways in sorted(_repair_steps().items()))
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
OP13 = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS f FROM conversations),
k AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE f <> 0),
o AS (SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS ini,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM k),
b AS (SELECT *, body = '' AS blank, body <> '' AND seen AS dup, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS trunc, body = '' OR seen AS must_go,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') AS bad FROM o),
e AS (SELECT conv_id, i, ini, must_go, trunc::INT AS cut FROM b),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (bad) AS illegal FROM b GROUP BY 1),
r AS (SELECT conv_id, 0::BIGINT AS row_at, repeat('0', 12) AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT r.conv_id, e.i, {_STEPS} FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.row_at + 1),
x AS (SELECT r.conv_id, least(w0, lpad((substr(w1, 1, 12)::BIGINT + 6)::VARCHAR, 12, '0') || substr(w1, 13) || 'II', lpad((substr(w2, 1, 12)::BIGINT + 3)::VARCHAR, 12, '0') || substr(w2, 13) || 'I', w3) AS w
  FROM r LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id WHERE row_at = coalesce(c.n, 0)),
l AS (SELECT conv_id, unnest(string_split(substr(w, 13), '')) AS edit, unnest(range(length(w) - 12)) AS p FROM x WHERE length(w) > 12),
m AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS place,
  sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) % 2 AS odd FROM l),
y AS (SELECT m.conv_id, string_agg(CASE edit WHEN 'K' THEN b.role ELSE CASE WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE b.text END, chr(10) ORDER BY p) AS lines
  FROM m LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.i = m.i WHERE edit <> 'D' GROUP BY 1)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  substr(w, 1, 12)::BIGINT AS cost, substr(w, 13) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM x LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM x.conv_id
"""

SQL = {
    "op1_license_scan": OP1, "op2_topk_search": OP2, "op4_quality_rules": OP4, "op5_warc_archive": OP5, "op8_source_mixing": OP8,
    "op11_near_vectors": OP11, "op12_ranked_search": OP12, "op13_repair_conversations": OP13,
}
