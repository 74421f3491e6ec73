"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
x AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM g JOIN f USING (h) WHERE first < doc_id),
q AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
s AS (SELECT q.r, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM q ANTI JOIN x ON q.r = x.r AND q.k = x.k GROUP BY q.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""

OP4 = rf"""
WITH alnum AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, (SELECT re FROM alnum)) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, (SELECT re FROM alnum)) AS w FROM benchmark),
ph AS (SELECT item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + 12], ' ') AS g FROM ph),
sizes AS (SELECT DISTINCT m FROM p),
dw AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes),
x AS (SELECT r, i, dw.m, item FROM dw JOIN p ON dw.m = p.m AND array_to_string(w[i:i + dw.m - 1], ' ') = g),
h AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM x) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

ESCAPED = r"regexp_replace(coalesce({}, ''), '<(\\*)\|', '<\1\\|', 'g')"

OP5 = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, 3 + len(regexp_extract_all({ESCAPED.format('text')}, '[^\x20\x09-\x0D]+')) AS tok,
  24 + len(replace({ESCAPED.format('role')}, chr(10), '<|newline|>')) + len({ESCAPED.format('text')}) AS chars FROM said),
c AS (SELECT conv_id, count(*) AS n, list(tok ORDER BY turn, role, text) AS tok, list(chars ORDER BY turn, role, text) AS chars,
  (list(role ORDER BY turn, role, text))[1] = 'system' AND count(*) > 1 AS sys,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id),
b AS (SELECT *, CASE WHEN sys THEN 1 ELSE 0 END AS body, CASE WHEN sys THEN tok[1] ELSE 0 END AS st, CASE WHEN sys THEN chars[1] ELSE 0 END AS sc FROM c),
w AS (
  SELECT conv_id, body AS first, 0 AS hist, 0::HUGEINT AS used FROM b
  UNION ALL
  SELECT conv_id, first, CASE
      WHEN first - 2 >= body AND tok[first] + tok[first - 1] <= 128 AND st + tok[first] + tok[first - 1] + tok[first + 1] <= 512 THEN 2
      WHEN first - 1 >= body AND tok[first] <= 128 AND st + tok[first] + tok[first + 1] <= 512 THEN 1 ELSE 0 END AS hist, 0
  FROM (SELECT b.*, w.first + greatest(1, len(list_filter(range(w.first + 1, n::BIGINT + 1), lambda e:
      list_sum(tok[w.first + 1:e]) + st + CASE WHEN hist > 0 THEN list_sum(tok[w.first + 1 - hist:w.first]) ELSE 0 END <= 512))) AS first
    FROM w JOIN b USING (conv_id)) WHERE first < n),
e AS (SELECT conv_id, first, hist, coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY first), n) AS stop, body, sc, chars FROM w JOIN b USING (conv_id)),
s AS (SELECT conv_id, sum(sc + list_sum(chars[first + 1 - hist:stop]))::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM b JOIN s USING (conv_id)
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT r, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure,
  unnest([100 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_dup_lines // n_words, 1000 * n_repeat_words // n_words]) AS x FROM j WHERE NOT base_failed),
k AS (SELECT *, (x >> greatest(0, len(bin(x)) - 6)) << greatest(0, len(bin(x)) - 6) AS bucket FROM v),
sizes AS (SELECT lang, source, count(*) AS docs, sum(count(*)) OVER (PARTITION BY lang) AS lang_docs FROM j WHERE NOT base_failed GROUP BY lang, source),
groups AS (SELECT lang, source, CASE WHEN docs >= 200 THEN 0 WHEN lang_docs >= 200 THEN 1 ELSE 2 END AS level FROM sizes),
pools AS (SELECT 0 AS level, lang, source, measure, bucket FROM k UNION ALL SELECT 1, lang, NULL, measure, bucket FROM k UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM k),
n AS (SELECT level, lang, source, measure, bucket, bucket + (1 << greatest(0, len(bin(bucket)) - 6)) AS edge, count(*) AS n FROM pools GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM n),
q AS (SELECT level, lang, source, measure, min(bucket) FILTER (WHERE 10 * upto >= total) AS low, min(bucket) FILTER (WHERE 2 * upto >= total) AS mid, min(edge) FILTER (WHERE 2 * upto >= total) AS mid_edge,
  min(edge) FILTER (WHERE 10 * upto >= 9 * total) AS high, min(edge) FILTER (WHERE 100 * upto >= 99 * total) AS top FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, max(4 * high - 3 * mid) FILTER (WHERE measure = 'word_length') AS wl_high, max(4 * low - 3 * mid_edge) FILTER (WHERE measure = 'word_length') AS wl_low,
  max(4 * high - 3 * mid) FILTER (WHERE measure = 'symbols') AS sy_high, max(4 * top - 3 * mid) FILTER (WHERE measure = 'dup_lines') AS dl_high,
  max(3 * top - 2 * mid) FILTER (WHERE measure = 'repeats') AS rp_high FROM q GROUP BY ALL),
gf AS (SELECT groups.lang, groups.source, f.* EXCLUDE (level, lang, source) FROM groups JOIN f ON groups.level = f.level
  AND CASE WHEN groups.level < 2 THEN groups.lang END IS NOT DISTINCT FROM f.lang AND CASE WHEN groups.level < 1 THEN groups.source END IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(100 * word_chars // n_words BETWEEN wl_low AND wl_high AND 1000 * n_symbols // n_words <= sy_high
    AND 1000 * n_dup_lines // n_words <= dl_high AND 1000 * n_repeat_words // n_words <= rp_high, false) AS kept
FROM j LEFT JOIN gf ON j.lang IS NOT DISTINCT FROM gf.lang AND j.source IS NOT DISTINCT FROM gf.source
"""


def floor_mean(total: str, n: str) -> str:
    return f"({total} - (({total} % {n}) + {n}) % {n}) // {n}"


FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def clusters_sql(rounds: int = 3) -> str:
    """Rounds written out one after the other; a distance and its centroid are one number."""
    near = "SELECT r, min(list_sum(list_transform(range(1, 65), lambda i: (q[i] - m[i]) * (q[i] - m[i])))::BIGINT * 16 + c) AS b FROM k, {} GROUP BY r"
    steps = []
    for t in range(rounds):
        steps.append(f"""a{t} AS ({near.format(f"c{t}")}),
s{t} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b % 16 AS c, unnest(range(1, 65)) AS i, unnest(q) AS x FROM k JOIN a{t} USING (r)) GROUP BY c, i),
m{t} AS (SELECT c, list({floor_mean("s", "n")} ORDER BY i) AS mean FROM s{t} GROUP BY c),
c{t + 1} AS (SELECT c, coalesce(mean, m) AS m FROM c{t} LEFT JOIN m{t} USING (c)),""")
    rest = "\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q AS m FROM k QUALIFY c < 16),
{rest}
f AS ({near.format(f"c{rounds}")})
SELECT vec_id, (b % 16)::INT AS cluster, b // 16 AS distance, sum(b // 16) OVER (PARTITION BY b % 16)::BIGINT AS cluster_inertia, sum(b // 16) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM k JOIN f USING (r) JOIN c{rounds} ON c = b % 16
"""


def codes_sql(rounds: int = 2) -> str:
    near = "SELECT r, p, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT * 64 + e) AS b FROM parts JOIN {} USING (p) GROUP BY r, p"
    steps = []
    for t in range(rounds):
        steps.append(f"""a{t} AS ({near.format(f"c{t}")}),
s{t} AS (SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, b % 64 AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM parts JOIN a{t} USING (r, p)) GROUP BY p, e, i),
m{t} AS (SELECT p, e, list({floor_mean("s", "n")} ORDER BY i) AS mean FROM s{t} GROUP BY p, e),
c{t + 1} AS (SELECT p, e, coalesce(mean, m) AS m FROM c{t} LEFT JOIN m{t} USING (p, e)),""")
    rest = "\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND {FINITE}),
parts AS (SELECT r, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS x FROM (SELECT r, q, unnest(range(0, 16)) AS p FROM k)),
c0 AS (SELECT p, e, x AS m FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM k QUALIFY e < 64) USING (r)),
{rest}
f AS ({near.format(f"c{rounds}")}),
g AS (SELECT r, string_agg(lpad(to_hex(b % 64), 2, '0'), '' ORDER BY p) AS code, sum(b // 64)::BIGINT AS error FROM f GROUP BY r)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN g USING (r)
"""


# bytes are pairs of hex digits; windows that start within or right behind a removed run belong to it
OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, s, md5(substring(h, 2 * s + 1, 200)) AS k FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
f AS (SELECT k, min((doc_id, s)) AS first FROM w GROUP BY k HAVING count(*) > 1),
x AS (SELECT r, s FROM w JOIN f USING (k) WHERE (doc_id, s) > first),
i AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 1 ELSE 0 END AS gap FROM x),
g AS (SELECT r, min(s) AS a, max(s) + 100 AS b FROM (SELECT r, s, sum(gap) OVER (PARTITION BY r ORDER BY s) AS island FROM i) GROUP BY r, island),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM g),
c AS (SELECT r, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept, max(b) AS e FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN h ELSE kept || substring(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

SQL: dict[str, str] = {
    "op2_substring_dedup": OP2,
    "op4_benchmark_decontamination": OP4,
    "op5_chat_formatting": OP5,
    "op9_quality_rules": OP9,
    "op11_centroid_clustering": clusters_sql(),
    "op12_suffix_array_dedup": OP12,
    "op13_vector_codes": codes_sql(),
}
