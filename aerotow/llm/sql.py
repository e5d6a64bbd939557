"""DuckDB SQL of the operator queries that SQL can express, written from their contracts."""

from . import licenses

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, greatest(len(w) - l + 2, 1))) AS i FROM d, (SELECT DISTINCT l FROM bw))),
hits AS (SELECT doc_id, l, i, item_id FROM dw JOIN bw USING (l, k)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"

ORACLE["op3_url_filter"] = rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (
  SELECT page_id, avg(bad) AS bad FROM (
    SELECT page_id, bad FROM (SELECT page_id, regexp_extract(path, '/(\d{{1,18}})(?:\.html|/)?$', 1) AS num FROM p) JOIN l ON num <> '' AND try_cast(num AS BIGINT) = doc_id)
  GROUP BY page_id),
h AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n,
    string_split(host, '.')[-1] AS suffix,
    array_to_string(string_split(host, '.')[(CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') LIKE 'example.%' THEN -3 ELSE -2 END):], '.') AS domain
  FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END FROM s) AS prior FROM s),
sk AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) AS e, sum(prior * (1 - prior) * (n - 1)) AS r FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM s1, (SELECT CASE WHEN coalesce(e, 0) <= 0 OR coalesce(r, 0) = 0 THEN 1000.0 ELSE least(greatest(r / e - 1, 2.0), 1000.0) END AS k FROM sk)),
d1 AS (SELECT d.*, prior FROM d JOIN s2 USING (suffix)),
dk AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) AS e, sum(prior * (1 - prior) * (n - 1)) AS r FROM d1 WHERE n > 0),
d2 AS (SELECT suffix, domain, (bad + k * prior) / (n + k) AS prior FROM d1, (SELECT CASE WHEN coalesce(e, 0) <= 0 OR coalesce(r, 0) = 0 THEN 1000.0 ELSE least(greatest(r / e - 1, 2.0), 1000.0) END AS k FROM dk)),
h1 AS (SELECT h.*, prior FROM h JOIN d2 USING (suffix, domain)),
hk AS (SELECT sum(n * (bad / n - prior) ** 2 - prior * (1 - prior)) AS e, sum(prior * (1 - prior) * (n - 1)) AS r FROM h1 WHERE n > 0),
h2 AS (SELECT host, n, k, (bad + k * prior) / (n + k) AS mean FROM h1, (SELECT CASE WHEN coalesce(e, 0) <= 0 OR coalesce(r, 0) = 0 THEN 1000.0 ELSE least(greatest(r / e - 1, 2.0), 1000.0) END AS k FROM hk)),
v AS (SELECT host, CASE WHEN mean - 1.64 * sqrt(mean * (1 - mean) / (n + k + 1)) > 0.35 THEN 'block' ELSE 'allow' END AS own FROM h2),
r AS (
  SELECT page_id, p.host, path, own, CASE
    WHEN ('.' || p.host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || p.host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || p.host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || p.host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN v ON p.host = v.host)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
  WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE own END AS verdict FROM r
"""

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE["op5_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, source, line, i, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE norm <> '' GROUP BY doc_id),
ln AS (SELECT doc_id, source, ('0x' || md5(norm)[1:15])::BIGINT AS h, len(string_split(norm, ' ')) AS n FROM raw WHERE norm <> ''),
pages AS (SELECT doc_id, string_agg(norm, chr(10) ORDER BY i) AS page FROM raw WHERE norm <> '' GROUP BY doc_id),
lo AS (SELECT ln.doc_id, source, h, n, page FROM ln JOIN pages USING (doc_id)),
often AS (SELECT source, h FROM lo GROUP BY source, h HAVING count(DISTINCT page) > 10),
share AS (SELECT doc_id, sum(CASE WHEN o.h IS NOT NULL THEN n ELSE 0 END) / sum(n) AS gone
          FROM lo LEFT JOIN often o ON lo.source IS NOT DISTINCT FROM o.source AND lo.h = o.h GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0) AS gone
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN share USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= 0.5 AS kept
FROM m
"""

_TOKENS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE["op4_ngram_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g, least(len(w), 4) AS l
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.l = b.l AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, e2.v FROM reach JOIN e2 ON reach.v = e2.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) m ON d.doc_id = m.u
"""

ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN b >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""

# CRC-32 in SQL: the table of 256 remainders, then a byte at a time over the hex digits of the UTF-8 bytes.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc32(text: str, table: str = "tab") -> str:
    """Unsigned CRC-32 of a text (not null), given the table as a list column."""
    byte = f"list_transform(range(length(hex(encode({text}))) // 2), lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    of = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return f"sha256({' || '.join(of(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


ORACLE["op11_merkle_manifest"] = rf"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab),
d AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
    {_leaf("CASE WHEN " + _crc32("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS now,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS size
  FROM documents, t),
-- nodes of the sources' trees and their level, places and level sizes
n AS (SELECT tree, 0 AS level, idx, size, leaf AS h FROM d
  UNION ALL
  SELECT tree, level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM n WHERE size > 1 GROUP BY tree, level, idx // 3, size),
sub AS (SELECT tree, h AS subroot FROM n WHERE size = 1),
u AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM sub) AS size, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE size > 1 GROUP BY level, idx // 3, size),
-- digests to the left and right of every node in its run
ns AS (SELECT tree, level, a.idx, coalesce(string_agg(CASE WHEN b.idx < a.idx THEN b.h END, '' ORDER BY b.idx), '') AS l, coalesce(string_agg(CASE WHEN b.idx > a.idx THEN b.h END, '' ORDER BY b.idx), '') AS r
  FROM n a JOIN n b USING (tree, level) WHERE a.size > 1 AND a.idx // 3 = b.idx // 3 GROUP BY tree, level, a.idx),
us AS (SELECT level, a.idx, coalesce(string_agg(CASE WHEN b.idx < a.idx THEN b.h END, '' ORDER BY b.idx), '') AS l, coalesce(string_agg(CASE WHEN b.idx > a.idx THEN b.h END, '' ORDER BY b.idx), '') AS r
  FROM u a JOIN u b USING (level) WHERE a.size > 1 AND a.idx // 3 = b.idx // 3 GROUP BY level, a.idx),
p AS (SELECT tree, 0 AS level, idx, idx AS first, now AS h, '' AS seen FROM d
  UNION ALL
  SELECT p.tree, p.level + 1, p.idx // 3, p.first, sha256(l || p.h || r), seen || l || r FROM p JOIN ns ON p.tree = ns.tree AND p.level = ns.level AND p.idx = ns.idx),
top AS (SELECT tree, first, arg_max(h, level) AS h, arg_max(seen, level) AS seen FROM p GROUP BY tree, first),
q AS (SELECT tree, first, 0 AS level, tree AS idx, h, seen FROM top
  UNION ALL
  SELECT q.tree, q.first, q.level + 1, q.idx // 3, sha256(l || q.h || r), seen || l || r FROM q JOIN us ON q.level = us.level AND q.idx = us.idx),
f AS (SELECT tree, first, arg_max(h, level) AS folded_root, arg_max(seen, level) AS seen FROM q GROUP BY tree, first),
root AS (SELECT h AS root FROM u WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN f ON d.tree = f.tree AND d.idx = f.first JOIN sub ON d.tree = sub.tree, root
"""

ORACLE["op12_spelling_variants"] = rf"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS tab),
r AS (SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
h AS (SELECT w, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r, t),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
-- words that differ by one edit share a variant with one letter left out or left open
k AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
  UNION SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i) FROM (SELECT word, n, unnest(range(1, length(word) + 2)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m,
    (list(other ORDER BY m DESC, encode(other)))[1] AS other FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL SELECT chain.word, form, step + 1 FROM chain JOIN forms ON chain.here = forms.word WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

#: The method's own templates: number, label, words, first and last place (exclusive) of the key phrase, whether it is a base phrase.
_TEMPLATES = ", ".join(f"({k}, '{t.label}', {list(t.words)}, {t.key[0]}, {t.key[1]}, {t.base})" for k, t in enumerate(licenses.templates()))

ORACLE["op2_license_scan"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t(k, label, ws, a, b, base) AS (VALUES {_TEMPLATES}),
tw AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS i, base FROM t),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
wt AS (SELECT tw.*, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) AS idf FROM tw LEFT JOIN df USING (word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY idf DESC, i) <= {licenses.RARE} AS rare FROM wt),
need AS (SELECT k, CASE WHEN base THEN count(*) ELSE greatest(1, (count(*) + 1) // 2) END AS needed FROM ranked WHERE rare GROUP BY k, base),
hits AS (SELECT doc_id, w, k, p - a AS start, p FROM (
    SELECT doc_id, w, k, ws[a + 1 : b] AS phrase, a, unnest(range(len(w) - (b - a) + 1)) AS p FROM d, t WHERE len(w) >= b - a)
  WHERE w[p + 1 : p + len(phrase)] = phrase),
held AS (SELECT doc_id, k, start, p, base, idf, rare, start + i >= 0 AND start + i < len(w) AND coalesce(w[(start + i + 1)::BIGINT] = word, false) AS ok FROM hits JOIN ranked USING (k)),
places AS (
  SELECT doc_id, k, start, p, base, CASE WHEN sum(idf) > 0 THEN sum(CASE WHEN ok THEN idf ELSE 0 END) / sum(idf) ELSE avg(ok::INT) END AS share, count(*) FILTER (ok AND rare) AS votes
  FROM held GROUP BY doc_id, k, start, p, base),
found AS (SELECT doc_id, label, p, places.base, share FROM places JOIN need USING (k) JOIN t USING (k) WHERE votes >= needed AND (places.base OR share >= {licenses.IN_PLACE}))
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (f.base) AS n_base, min(p) FILTER (f.base) AS first_word, max(p) FILTER (f.base) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (f.base))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels, coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id, w
"""
