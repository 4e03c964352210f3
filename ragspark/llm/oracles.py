"""SQL restatements of the corpus queries that SQL can express."""

#: Payloads, digests and revisits from the pages alone; ids, addresses and dates by the rules of the formats.
OP6 = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
  FROM (
    SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
      min(page_id) OVER (PARTITION BY sha256(body)) AS first_id
    FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)))
"""

#: Rules as a join on host suffixes; aliases as what links reach from blocked addresses. Targets relative to a folder do not occur.
OP11 = r"""
WITH RECURSIVE rules(decision, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
pages_n AS (SELECT row_number() OVER () AS n, page_id, url, html FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(
    regexp_replace(regexp_replace(html, '<!--.*?(-->|\z)', ' ', 'gs'), '<script\b.*?(</script|\z)|<style\b.*?(</style|\z)|<textarea\b.*?(</textarea|\z)|<title\b.*?(</title|\z)', ' ', 'gis'),
    '<(?:link|meta)\b[^<>]*>', 0, 'i')) AS tag
  FROM pages_n WHERE url LIKE '%://%' AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')
),
targets AS (
  SELECT url, CASE
      WHEN tag ILIKE '<link%' AND regexp_matches(tag, '[\s"''/]rel\s*=\s*["'']?([^"''<>]*\s)?canonical[\s"''>]', 'i')
        THEN regexp_extract(tag, '[\s"''/]href\s*=\s*["'']?([^"''<>\s]+)', 1, 'i')
      WHEN tag ILIKE '<meta%' AND regexp_matches(tag, '[\s"''/]http-equiv\s*=\s*["'']?\s*refresh[\s"''>]', 'i')
        THEN regexp_extract(tag, '[;,]\s*url\s*=\s*["'']?([^"''<>]+)', 1, 'i') END AS target
  FROM tags
),
named(url) AS (
  SELECT url FROM pages_n WHERE url LIKE '%://%'
  UNION SELECT url FROM targets WHERE target <> ''
  UNION SELECT CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN split_part(url, '://', 1) || ':' || target
    ELSE regexp_extract(url, '^[^:]*://[^/?#]*') || target END
  FROM targets WHERE target LIKE '%://%' OR target LIKE '/%'
),
parts AS (
  SELECT url,
    translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path,
    lower(split_part(url, '://', 1)) || '://' || lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'))
      || CASE WHEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END
      || regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^#]*)', 1) AS node
  FROM named
),
judged AS (
  SELECT url, host, path, node,
    arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(decision, length(rhost || rpath)) AS decision
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL
),
links AS (
  SELECT s.node AS a, t.node AS b FROM targets x
  JOIN parts s ON s.url = x.url
  JOIN parts t ON t.url = CASE WHEN target LIKE '%://%' THEN target WHEN target LIKE '//%' THEN split_part(x.url, '://', 1) || ':' || target
    ELSE regexp_extract(x.url, '^[^:]*://[^/?#]*') || target END
  WHERE target LIKE '%://%' OR target LIKE '/%'
),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
blocked(node) AS (
  SELECT node FROM judged WHERE decision = 'block' AND node IN (SELECT a FROM twoway)
  UNION SELECT b FROM blocked JOIN twoway ON a = blocked.node
)
SELECT page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, rule,
  CASE WHEN rule IS NOT NULL THEN decision WHEN j.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM pages_n p LEFT JOIN judged j ON j.url = p.url
"""



def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text: eight halvings for each byte, with the usual reflected polynomial."""
    halvings = "list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {halvings}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: Cheapest edits turn by turn: for each state of the roles the least cost, audit and repaired lines so far, insertions first.
OP12 = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("spot")} % 20 AS draw
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot FROM conversations)
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE WHEN draw = 3 THEN 2 ELSE 1 END) WHERE draw <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged
),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
walk(conv_id, n, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}}, {{c: 1000000000::BIGINT, a: '', t: []::VARCHAR[]}},
    {{c: 5::BIGINT, a: 'I', t: ['user:']}}, {{c: 10::BIGINT, a: 'II', t: ['user:', 'assistant:']}}
  FROM judged
  UNION ALL
  SELECT conv_id, n, q0, q1,
    list_min([q2, {{c: q0.c + 5, a: q0.a || 'I', t: list_append(q0.t, 'user:')}}, {{c: q1.c + 5, a: q1.a || 'I', t: list_append(q1.t, 'user:')}},
      {{c: q3.c + 5, a: q3.a || 'I', t: list_append(q3.t, 'user:')}}]),
    list_min([q3, {{c: q2.c + 5, a: q2.a || 'I', t: list_append(q2.t, 'assistant:')}},
      {{c: q0.c + 10, a: q0.a || 'II', t: list_concat(q0.t, ['user:', 'assistant:'])}},
      {{c: q1.c + 10, a: q1.a || 'II', t: list_concat(q1.t, ['user:', 'assistant:'])}}])
  FROM (
    SELECT w.conv_id, j.n,
      {{c: q0.c + 2, a: q0.a || 'D', t: q0.t}} AS q0,
      list_min([{{c: q1.c + 2, a: q1.a || 'D', t: q1.t}},
        {{c: q0.c + keep + CASE initial WHEN 's' THEN 0 ELSE 1000000000 END, a: q0.a || 'K', t: list_append(q0.t, line)}}]) AS q1,
      list_min([{{c: q2.c + 2, a: q2.a || 'D', t: q2.t}}] || list_transform([q0, q1, q3], lambda q: {{c: q.c + keep + CASE initial WHEN 'u' THEN 0 ELSE 1 END,
        a: q.a || CASE initial WHEN 'u' THEN 'K' ELSE 'R' END, t: list_append(q.t, CASE initial WHEN 'u' THEN line ELSE 'user:' || text END)}})) AS q2,
      list_min([{{c: q3.c + 2, a: q3.a || 'D', t: q3.t}}, {{c: q2.c + keep + CASE initial WHEN 'a' THEN 0 ELSE 1 END,
        a: q2.a || CASE initial WHEN 'a' THEN 'K' ELSE 'R' END, t: list_append(q2.t, CASE initial WHEN 'a' THEN line ELSE 'assistant:' || text END)}}]) AS q3
    FROM walk w JOIN (
      SELECT *, role || ':' || text AS line, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS keep
      FROM judged) j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1)
),
ended AS (
  SELECT conv_id, list_min([q0, q3]) AS best FROM walk
  QUALIFY n = max(n) OVER (PARTITION BY conv_id)
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""

#: Every prefix written out as the list of its turns' digests; subtrees by the members' own prefixes.
OP13 = rf"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT conv_id, {_crc32("id")} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS id FROM own)
),
turns AS (
  SELECT i.conv_id, 0 AS part, n, role, text FROM ids i JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 5 AND n <= h
  UNION ALL SELECT i.conv_id, 1, n, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND n > h
),
steps AS (
  SELECT conv_id, count(*) OVER w AS depth, string_agg(sha256(length(role) || ':' || role || sha256(text)), ',') OVER w AS key, octet_length(encode(text)) AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
),
nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    CASE WHEN any_value(depth) = 0 THEN NULL WHEN any_value(depth) = 1 THEN '' ELSE substr(key, 1, length(key) - 65) END AS parent
  FROM steps GROUP BY key
),
below AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
),
subtree AS (
  SELECT s.key, sum(n.saved) AS saved_tokens, count(*) FILTER (n.key NOT IN (SELECT key FROM below)) AS n_leaves
  FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.key
),
ends AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM steps GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN below b ON b.key = n.key
JOIN subtree s ON s.key = n.key LEFT JOIN ends e ON e.key = n.key
"""

ORACLES: dict[str, str] = {"op6_warc": OP6, "op11_url_filter": OP11, "op12_structure_repair": OP12, "op13_prefix_trie": OP13}
