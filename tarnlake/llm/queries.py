"""The queries of this package, by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from tarnlake.llm.compression import op13_compression
from tarnlake.llm.divergence import op11_divergence
from tarnlake.llm.fingerprints import op8_fingerprints
from tarnlake.llm.lattice import op1_lm_score
from tarnlake.llm.licenses import op3_licenses
from tarnlake.llm.mixing import op4_mixing
from tarnlake.llm.near_dup import op5_near_dup
from tarnlake.llm.packing import op10_packing
from tarnlake.llm.pii import op2_pii
from tarnlake.llm.prefix_trie import op12_prefix_trie
from tarnlake.llm.quality import op6_quality
from tarnlake.llm.substring_dedup import op9_substring_dedup
from tarnlake.llm.toxicity import op7_toxicity

QUERIES = {"op1_lm_score": op1_lm_score, "op2_pii": op2_pii, "op3_licenses": op3_licenses, "op4_mixing": op4_mixing, "op5_near_dup": op5_near_dup, "op6_quality": op6_quality, "op7_toxicity": op7_toxicity, "op8_fingerprints": op8_fingerprints, "op9_substring_dedup": op9_substring_dedup, "op10_packing": op10_packing, "op11_divergence": op11_divergence, "op12_prefix_trie": op12_prefix_trie, "op13_compression": op13_compression}
#: All pairs that share a shingle, counted, and the closure of the links; for small tables.
NEAR_DUP = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS sh FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a),
k AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY 1)
SELECT k.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id"""
#: Every kept term of every pair of sources, without postings.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
w AS (SELECT k, lang, source, unnest(l) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS n FROM kept GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY 1, 2, 3),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) y ON y.lang = x.lang AND y.source = x.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * v.v) AS p, 1 + (1000000000 * (n_lang + 5)::HUGEINT) // (v.n + 5 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50"""
#: Every prefix of every conversation; the checksum bit by bit.
PREFIX_TRIE = r"""WITH RECURSIVE t AS (SELECT conv_id, turn, md5(concat(length(role), ':', role, text)) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS p FROM t),
z AS (SELECT conv_id, count(*) AS n FROM o GROUP BY 1),
crc(conv_id, s, j, c) AS (SELECT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295::BIGINT FROM z
  UNION ALL SELECT conv_id, s, j + 1, xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) FROM (SELECT conv_id, s, j, CASE WHEN j % 8 = 0 THEN xor(c, ascii(s[j // 8 + 1])::BIGINT) ELSE c END AS b FROM crc WHERE j < 8 * length(s))),
h AS (SELECT crc.conv_id, crc.conv_id - crc.conv_id % 20 AS base, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE j = 8 * length(s)),
r AS (SELECT h.conv_id, o.p AS p, o.digest, o.words FROM h JOIN o ON o.conv_id = h.base AND o.p < h.h
  UNION ALL SELECT h.conv_id, o.p - h.h + least(h.h, coalesce(z.n, 0)), o.digest, o.words FROM h JOIN o ON o.conv_id = h.conv_id AND o.p >= h.h LEFT JOIN z ON z.conv_id = h.base),
l AS (SELECT z.conv_id, coalesce(x.ds, []::VARCHAR[]) AS ds, coalesce(x.ws, []::BIGINT[]) AS ws FROM z LEFT JOIN (SELECT conv_id, list(digest ORDER BY p) AS ds, list(words ORDER BY p) AS ws FROM r GROUP BY 1) x ON x.conv_id = z.conv_id),
m AS (SELECT conv_id, d AS depth, array_to_string(ds[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(ds[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, d = len(ds) AS ended
  FROM (SELECT conv_id, ds, ws, unnest(range(0, len(ds) + 1)) AS d FROM l)),
n AS (SELECT depth, k, max(up) AS up, max(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.depth = n.depth AND c.k = n.k),
s AS (SELECT m.depth, m.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.depth = f.depth AND s.k = f.k LEFT JOIN f p ON p.depth = f.depth - 1 AND p.k = f.up"""

ORACLES: dict[str, str] = {"op5_near_dup": NEAR_DUP, "op11_divergence": DIVERGENCE, "op12_prefix_trie": PREFIX_TRIE}
