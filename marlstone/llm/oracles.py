"""SQL of the queries that SQL can express: brute force over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM h)),
 r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
 s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id
  ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r)),
 p AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY 1, 2),
 q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
 c AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), ''
  ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS kept FROM q JOIN h ON q.doc_id = h.doc_id GROUP BY 1)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
  FROM h LEFT JOIN c ON h.doc_id = c.doc_id"""

OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
 w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
 r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
 c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM r),
 e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
 k AS (SELECT e.doc_id, count(*) AS n, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept FROM e LEFT
  JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT
  JOIN k ON d.doc_id = k.doc_id"""

OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1,
  greatest(1, len(ws) - 3) + 1)) AS i FROM d WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
 t AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT l.b, t.r FROM t JOIN l ON l.a = t.doc_id),
 m AS (SELECT doc_id, min(r) AS component_id FROM t GROUP BY 1)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id"""

OP8 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
 l AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS line FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(24 + length(regexp_replace(line, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id"""

OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM benchmark),
 v AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, i, i + 12), ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
 w AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM v))),
 m AS (SELECT DISTINCT doc_id, i, w.n, item_id FROM w JOIN v ON w.n = v.n AND w.g = v.g),
 h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM m) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

OP10 = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
 p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
 r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
 m AS (SELECT page_id, arg_max(rhost || rpath, (length(rhost), length(rpath))) AS rule, arg_max(verdict, (length(rhost), length(rpath))) AS verdict
  FROM p, r WHERE (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id"""


def crc_table() -> list[int]:
    """Of the reflected polynomial EDB88320: what each byte adds to a checksum."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP13 = f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{5,}}')), '{UPPER}', '{LOWER}') AS w FROM documents),
 d AS (SELECT w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
 h AS (SELECT w, c, xor(4294967295::BIGINT, list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substring(x, i, 2))::BIGINT),
  lambda s, b: xor(s >> 8, {crc_table()}[xor(s & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM d),
 n AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1
  HAVING sum(c) >= 3 AND length(word) >= 5),
 x AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
 e AS (SELECT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, n.word, n.n FROM x JOIN n ON x.cut = n.word UNION SELECT n.word, x.word, x.n FROM x JOIN n ON x.cut = n.word),
 f AS (SELECT a, count(*) AS n_near, min({{'less': -n, 'form': b}}) AS best FROM e GROUP BY 1),
 g AS (SELECT word, CASE WHEN -best.less >= 2 * n THEN best.form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM n LEFT JOIN f ON word = a),
 t(word, reached) AS (SELECT word, word FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON t.reached = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, t.reached AS root, g.n, g.n_near, g.form_n FROM g JOIN t ON t.word = g.word JOIN g q ON q.word = t.reached AND q.form IS NULL"""
