"""The operators' results as DuckDB SQL over the whole tables, where SQL can
express them: by definition (all windows, all pairs that share a shingle), not
by the operators' methods."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = " || ".join(
    f"substr('{_BASE32}', (CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) % 32 + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP1 = f"""
SELECT page_id, size AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h,
             MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
      FROM pages)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                          ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
      FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, UNNEST(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS v, a AS c FROM two UNION SELECT two.b, r.c FROM r JOIN two ON two.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, coalesce(g.c, n.doc_id) AS component_id,
       coalesce(g.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN (SELECT v, MIN(c) AS c FROM r GROUP BY v) g ON g.v = n.doc_id"""

# Texts are cut into pieces of 1000 bytes first: a substring costs as much as its place in the string.
OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2098) AS h, CAST(len(h) / 2 - pos AS BIGINT) AS rest
      FROM (SELECT doc_id, h, UNNEST(range(0, CAST(len(h) / 2 AS BIGINT), 1000)) AS pos FROM d)),
w AS (SELECT doc_id, pos + i AS p, md5_number(substr(h, 2 * i + 1, 100)) AS x
      FROM (SELECT *, UNNEST(range(least(1000, rest - 49))) AS i FROM c)),
o AS (SELECT x, MIN(doc_id) AS o, MAX(doc_id) AS l FROM w GROUP BY x HAVING MIN(doc_id) < MAX(doc_id)),
g AS (SELECT DISTINCT doc_id, p FROM w JOIN o USING (x) WHERE o.o < doc_id),
t AS (SELECT doc_id, pos + i AS p, substr(h, 2 * i + 1, 2) AS x
      FROM (SELECT *, UNNEST(range(least(1000, rest))) AS i FROM c WHERE doc_id IN (SELECT doc_id FROM g))),
m AS (SELECT t.doc_id, t.p, t.x, coalesce(t.p - g.p < 50, false) AS gone
      FROM t ASOF LEFT JOIN g ON t.doc_id = g.doc_id AND t.p >= g.p),
k AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COUNT(*) FILTER (gone AND NOT was) AS n_spans,
             coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept
      FROM (SELECT *, coalesce(LAG(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS was FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

OP11 = f"""
WITH p AS (SELECT lang, row_number() OVER () AS p, piece
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        UNNEST(string_split_regex(coalesce({_LOWER}, ''), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM t, (SELECT UNNEST([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, COUNT(*) AS a FROM g GROUP BY ALL HAVING COUNT(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
held AS (SELECT lang, phrase, MAX(a) AS above
         FROM (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
               FROM (SELECT lang, a, w, m, UNNEST(range(1, k - m + 2)) AS i FROM c, (SELECT UNNEST([2, 3]) AS m) WHERE m < k))
         GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, cut,
             CAST(2000000 * CAST(c.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
      FROM (SELECT *, UNNEST(range(1, k)) AS cut FROM c) c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
      WHERE h.above IS NULL OR 100 * h.above < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM o JOIN (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM t GROUP BY lang) USING (lang) WHERE rank <= 2000"""

# A rebuilt conversation is the list of its turns; nodes are the distinct first parts of these lists.
OP12 = f"""
WITH RECURSIVE bits AS (SELECT c, 0 AS i, CAST(4294967295 AS BIGINT) AS x, encode(CAST(c AS VARCHAR)) AS b
             FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
             UNION ALL
             SELECT c, i + 1, list_reduce(list_prepend(xor(x, CAST(ascii(substr(CAST(c AS VARCHAR), i + 1, 1)) AS BIGINT)),
                    range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), b
             FROM bits WHERE i < octet_length(b)),
h AS (SELECT c, xor(x, 4294967295) % 4 AS h FROM bits WHERE i = octet_length(b)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             sha256(coalesce(role, '') || ' / ' || coalesce(text, '')) AS x,
             len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.c, i, x, w FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.i <= h.h
      UNION ALL SELECT h.c, 1000000 + i, x, w FROM h JOIN t ON t.c = h.c AND t.i > h.h),
s AS (SELECT h.c, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), []) AS xs,
             coalesce(list(w ORDER BY i) FILTER (x IS NOT NULL), []) AS ws FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
p AS (SELECT c, d, array_to_string(xs[:d], '') AS path, array_to_string(xs[:d - 1], '') AS up, len(xs) = d AS ends,
             CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
      FROM (SELECT *, UNNEST(range(0, len(xs) + 1)) AS d FROM s)),
n AS (SELECT path, d, MIN(CASE WHEN d > 0 THEN up END) AS up, MIN(c) AS c, COUNT(*) AS n, MIN(w) AS w,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e
      FROM p GROUP BY path, d),
k AS (SELECT up AS path, COUNT(*) AS kids FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (path)),
b AS (SELECT a.path, SUM(CAST(m.kids = 0 AS INT)) AS leaves, SUM((m.n - 1) * m.w) AS saved
      FROM m JOIN m a ON starts_with(m.path, a.path) GROUP BY a.path)
SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.kids AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
FROM m JOIN b ON b.path = m.path LEFT JOIN n u ON u.path = m.up AND m.d > 0"""

ORACLE_SQL = {"op1_warc": OP1, "op3_minhash": OP3, "op9_suffix": OP9, "op11_phrases": OP11, "op12_prefix_trie": OP12}
