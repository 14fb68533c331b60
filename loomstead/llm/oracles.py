"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP4 = r"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, rid,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), met AS (
  SELECT p.rid, r.rhost || r.rpath AS rule, r.action,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM parts p LEFT JOIN met m ON m.rid = p.rid AND m.k = 1
"""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
  FROM src
), filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM weighed
), levels AS (
  SELECT *, budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k DESC) AS wrest
  FROM filled
), open AS (
  SELECT min(k) AS k0 FROM levels WHERE rest * w / wrest <= 2.0::DOUBLE * source_size
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN o.k0 IS NULL OR l.k < o.k0 THEN 2.0::DOUBLE * l.source_size
              ELSE (SELECT rest FROM levels WHERE k = o.k0) * l.w / (SELECT wrest FROM levels WHERE k = o.k0) END AS target
  FROM levels l, open o
), ranked AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS r, count(*) OVER (PARTITION BY s.source) AS n,
         ('0x' || substr(md5('17|' || coalesce('s' || s.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, (CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END)::DOUBLE AS pos FROM ranked
)
SELECT doc_id, size, source_size, target, (floor((pos + 1) * e + u) - floor(pos * e + u))::BIGINT * size AS taken
FROM placed
"""

OP11 = r"""
WITH live AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM live a JOIN live r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

OP13 = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), summed AS (
  SELECT k.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS what
  FROM keyed k, crc
), harmed AS (
  SELECT conv_id, coalesce('c' || conv_id::VARCHAR, 'null') AS g, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE what <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, substr(sha256(length(role) || ':' || role || text), 1, 32), copy) AS i FROM harmed
), faulty AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS short,
         left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS before
  FROM ordered
), told AS (
  SELECT g, i, role, text, c, blank OR again AS gone, (short AND NOT blank AND NOT again)::INT AS extra FROM faulty
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (short AND NOT blank AND NOT again) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY g
), ins(q, k, q2, put) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (3, 1, 2, ['user:']), (2, 1, 3, ['assistant:']),
         (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (3, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:'])
), arcs(letter, role, q, q2, cost) AS (
  VALUES ('D', NULL, 0, 0, 3), ('D', NULL, 1, 1, 3), ('D', NULL, 2, 2, 3), ('D', NULL, 3, 3, 3), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'a', 2, 3, 0), ('K', 'u', 3, 2, 0),
         ('R', 'user', 0, 2, 2), ('R', 'user', 1, 2, 2), ('R', 'assistant', 2, 3, 2), ('R', 'user', 3, 2, 2)
), best AS (
  SELECT g, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'put': []::VARCHAR[]} AS b FROM counts
  UNION ALL
  SELECT g, i, q, arg_min(b, lpad(b.cost::VARCHAR, 12, '0') || b.audit) FROM (
    SELECT p.g, t.i, a.q2 AS q, {
      'cost': p.b.cost + 2 * n.k + a.cost + CASE WHEN a.letter = 'D' THEN 0 ELSE t.extra END,
      'audit': p.b.audit || repeat('I', n.k) || a.letter,
      'put': p.b.put || n.put || CASE a.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [a.role || ':' || t.text] END} AS b
    FROM best p JOIN told t ON t.g = p.g AND t.i = p.i + 1 JOIN ins n ON n.q = p.q JOIN arcs a ON a.q = n.q2 AND (a.letter = 'D' OR NOT t.gone AND (a.letter = 'R' OR a.role = t.c))
  ) GROUP BY g, i, q
), ended AS (
  SELECT p.g, arg_min({'cost': p.b.cost + 2 * n.k, 'audit': p.b.audit || repeat('I', n.k), 'put': p.b.put || n.put}, lpad((p.b.cost + 2 * n.k)::VARCHAR, 12, '0') || p.b.audit || repeat('I', n.k)) AS b
  FROM best p JOIN counts c ON c.g = p.g AND c.n = p.i JOIN ins n ON n.q = p.q WHERE n.q2 IN (0, 3) GROUP BY p.g
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('c' || conv_id::VARCHAR, 'null') AS g FROM conversations) o LEFT JOIN counts USING (g) LEFT JOIN ended USING (g)
"""

ORACLES = {"op4_url_rules": OP4, "op9_systematic_mix": OP9, "op11_vantage_negatives": OP11, "op13_conversation_repair": OP13}
