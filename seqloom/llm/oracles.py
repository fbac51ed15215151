"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from . import mixing, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
  d AS (SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS x, keeper FROM p JOIN k ON p.h = k.h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d"""


def _op2(spread: int = 6, min_group: int = 30) -> str:
    ratios = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS ratio, CASE WHEN {den} > 0 THEN ({scale} * {num}) // {den} ELSE 0 END AS v FROM m WHERE NOT base_failed" for r, (num, den, scale, *_) in quality.RATIOS.items())
    quart = lambda keys, source: f"""SELECT {keys + ', ' if keys else ''}ratio, max(total) AS total, min(CASE WHEN 4 * cum >= total THEN bin END) AS q25, min(CASE WHEN 4 * cum >= 3 * total THEN bin END) AS q75
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys + ', ' if keys else ''}ratio) AS total, sum(n) OVER (PARTITION BY {keys + ', ' if keys else ''}ratio ORDER BY bin) AS cum FROM {source}) z GROUP BY ALL"""  # noqa: E731
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {v[3]}" for r, v in quality.RATIOS.items()) + " END"
    ok = " AND ".join(
        f"coalesce(({v[2]} * {v[0]}) // nullif({v[1]}, 0), 0) {'>=' if side == 'low' else '<='} coalesce((SELECT {'q25 - width' if side == 'low' else 'q75 + width'} FROM u WHERE u.ratio = '{r}' AND u.lang IS NOT DISTINCT FROM m.lang AND u.source IS NOT DISTINCT FROM m.source), {'-1' if side == 'low' else '1e18'})"
        for r, v in quality.RATIOS.items() for side in v[4])
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
  g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d) a) b),
  rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g WHERE c > 1) e GROUP BY rid),
  l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda s : regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
  m AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM d JOIN l USING (rid) LEFT JOIN rep USING (rid)),
  h AS MATERIALIZED (SELECT lang, source, ratio, CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END AS bin, count(*) AS n FROM ({ratios}) r GROUP BY ALL),
  hl AS (SELECT lang, ratio, bin, sum(n) AS n FROM h GROUP BY ALL), ho AS (SELECT ratio, bin, sum(n) AS n FROM h GROUP BY ALL),
  a AS ({quart('lang, source', 'h')}), b AS ({quart('lang', 'hl')}), c AS ({quart('', 'ho')}),
  s AS (SELECT a.lang, a.source, a.ratio, CASE WHEN a.total >= {min_group} THEN a.q25 WHEN b.total >= {min_group} THEN b.q25 ELSE c.q25 END AS q25, CASE WHEN a.total >= {min_group} THEN a.q75 WHEN b.total >= {min_group} THEN b.q75 ELSE c.q75 END AS q75
    FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.ratio = b.ratio JOIN c ON a.ratio = c.ratio),
  u AS MATERIALIZED (SELECT *, {spread} * greatest(q75 - q25, {least}) AS width FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {ok} AS kept FROM m"""


def _time(schedule, u: str) -> str:
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    total, done, cases = sum(area), 0.0, []
    f = lambda x: f"CAST({x!r} AS DOUBLE)"
    for (t0, v0), (t1, v1), x in zip(schedule, schedule[1:], area):
        need, slope = f"({u} * {f(total)} - {f(done)})", (v1 - v0) / (t1 - t0)
        at = f"{f(t0)} + {need} / {f(v0)}" if slope == 0 else f"{f(t0)} + (sqrt(greatest({f(v0 * v0)} + {f(2 * slope)} * {need}, 0.0::DOUBLE)) - {f(v0)}) / {f(slope)}"
        done += x
        cases.append(f"WHEN {u} * {f(total)} <= {f(done)} THEN {at}")
    return f"least(greatest(coalesce(CASE {' '.join(cases)} ELSE 1.0::DOUBLE END, 0.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


def _op4() -> str:
    n = len(mixing.WEIGHTS)
    weight = "CASE kind " + " ".join(f"WHEN {k} THEN {float(w)}::DOUBLE" for k, w in enumerate(mixing.WEIGHTS)) + " END"
    when = lambda c, taken: f"CASE WHEN {taken} > 0 THEN round(CASE kind " + " ".join(f"WHEN {k} THEN {_time(s, f'({c} / target)')}" for k, s in enumerate(mixing.SCHEDULES)) + " END, 9) END"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
  s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} AS kind FROM d GROUP BY source),
  s1 AS (SELECT *, {weight} AS weight, 2.0::DOUBLE * source_size AS cap FROM s0), s2 AS (SELECT *, cap / weight AS level FROM s1),
  s3 AS (SELECT *, row_number() OVER w AS r, least(1.5::DOUBLE * sum(source_size) OVER (), sum(cap) OVER ()) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM s2 WINDOW w AS (ORDER BY level, source NULLS LAST)),
  s AS (SELECT source, source_size, kind, least(cap, coalesce((SELECT min_by(remains / heavy, r) FROM s3 WHERE remains / heavy <= level) * weight, cap)) AS target FROM s3),
  c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
  t AS (SELECT doc_id, size, source_size, kind, target, CAST(a AS BIGINT) AS a, CAST(a + source_size AS BIGINT) AS b, greatest(least(CAST(floor(target) AS BIGINT) - a, size), 0) AS x, greatest(least(CAST(floor(target) AS BIGINT) - a - source_size, size), 0) AS y
    FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, CAST(x + y AS BIGINT) AS taken, {when('a', 'x')} AS position, {when('b', 'y')} AS position_again FROM t"""


OP5 = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d) a),
  n AS MATERIALIZED (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
  i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  e AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
  r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT v AS doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id FROM r JOIN n ON n.doc_id = v GROUP BY v"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_BENCH_WORDS} AS w FROM documents), b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
  x AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS j FROM b WHERE len(w) > 0) t),
  o AS MATERIALIZED (SELECT rid, i, p.m, item_id FROM (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM x) y) z) p JOIN x ON p.m = x.m AND p.g = x.g),
  h AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS q FROM o) u GROUP BY 1),
  k AS (SELECT rid, count(*) AS n, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS v FROM o) u GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(k.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)"""



def _op11(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """All rounds written out; every vector meets every centroid."""
    apart = f"list_sum(list_transform(range(1, {dim + 1}), lambda i : (v[i] - c[i]) * (v[i] - c[i])))"
    near = lambda c: f"(SELECT rid, vec_id, v, min(struct_pack(d := {apart}, j := j)) AS b FROM e CROSS JOIN {c} GROUP BY rid, vec_id, v)"
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED {near(f'c{r}')},
  m{r} AS MATERIALIZED (SELECT j, list(x ORDER BY i) AS c FROM (SELECT b.j AS j, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY 1, 2) s GROUP BY j),
  c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x : CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT {k}) s),
  {', '.join(steps)},
  z AS MATERIALIZED (SELECT vec_id, b.j AS j, CAST(b.d AS BIGINT) AS d FROM {near(f'c{rounds}')} y)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (j)"""


_TURN = r"CAST(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)) AS BIGINT)"
OP13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)) s),
  g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS x,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS y, CAST(sum({_TURN}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(x) AS turns_sha256, CAST(length(y) AS BIGINT) AS loss_chars, sha256(y) AS loss_sha256, formatted_chars FROM g"""

ORACLES = {"op1_warc": OP1, "op2_quality_rules": _op2(), "op4_curriculum_mix": _op4(), "op5_jaccard_join": OP5, "op9_decontamination": OP9, "op11_centroid_clustering": _op11(),
           "op13_chat_format": OP13}
