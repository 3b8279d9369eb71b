"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversation_trie import op12_conversation_trie
from .line_dedup import op4_line_dedup
from .media import op1_media
from .mixing import op8_mixing
from .multiset_hash import op9_multiset_hash
from .packing import op13_packing
from .pieces import op2_pieces
from .resampling import op11_resampling
from .simhash import op5_simhash
from .token_counts import op10_token_counts
from .token_shards import op3_token_shards
from .toxicity import op7_toxicity
from .warc import op6_warc

QUERIES = {f.__name__: f for f in (op1_media, op2_pieces, op3_token_shards, op4_line_dedup, op5_simhash, op6_warc, op7_toxicity, op8_mixing, op9_multiset_hash, op10_token_counts, op11_resampling, op12_conversation_trie, op13_packing)}

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')"

#: A CTE with the 256 steps of a byte in CRC-32, and the CRC-32 of a text's UTF-8 bytes.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

#: The rounds of line templates that the SQL has; on its tables the last ones find nothing more.
_OF_SQL = range(1, 5)
_ROUNDS = ",\n".join(rf"""links{k} AS (SELECT a.masked AS a, b.masked AS b FROM pool{k} a JOIN pool{k} b USING (leaf) WHERE a.masked <> b.masked AND list_sum(list_transform(list_zip(a.tokens, b.tokens), lambda z: (z[1] = z[2])::INTEGER)) >= 0.8::DOUBLE * len(a.tokens) - 1e-9),
reach{k}(a, b) AS (SELECT a, b FROM links{k} UNION SELECT reach{k}.a, links{k}.b FROM reach{k} JOIN links{k} ON reach{k}.b = links{k}.a),
proposing{k} AS (SELECT r.masked, r.template, p.leaf, p.tokens FROM (SELECT a AS masked, min(b) AS template FROM reach{k} GROUP BY 1) r JOIN pool{k} p USING (masked)),
places{k} AS (SELECT masked, template, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM proposing{k}),
votes{k} AS (SELECT template, place, token, count(*) AS c FROM places{k} GROUP BY ALL),
fixed{k} AS (SELECT template, place, token FROM votes{k} JOIN (SELECT template, count(*) AS n FROM proposing{k} GROUP BY 1) USING (template) WHERE 2 * c > n),
told{k} AS (SELECT masked, template, leaf, tokens, (SELECT count(*) FROM places{k} p JOIN fixed{k} f USING (template, place, token) WHERE p.masked = g.masked) >= 0.8::DOUBLE * len(tokens) - 1e-9 AS member FROM proposing{k} g),
pool{k + 1} AS (SELECT leaf, masked, tokens FROM told{k} WHERE NOT member AND template IN (SELECT template FROM told{k} WHERE member))""" for k in _OF_SQL)

#: DuckDB SQL for the queries that it can express. The others need trained models, tokenizers, images, or hashes that
#: DuckDB lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS kept FROM p GROUP BY 1)
SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to, url FROM p JOIN m USING (h)""",
    "op4_line_dedup": rf"""WITH RECURSIVE cut AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
masks AS (SELECT doc_id, pos, line, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM cut),
counted AS (SELECT *, CASE WHEN masked = '' THEN 0 ELSE length(masked) - length(replace(masked, ' ', '')) + 1 END AS n FROM masks),
lines AS (SELECT *, n || '|' || array_to_string(string_split(masked, ' ')[1:3], ' ') AS leaf FROM counted),
several AS (SELECT leaf FROM lines WHERE n >= 5 GROUP BY 1 HAVING count(DISTINCT masked) > 1),
pool1 AS (SELECT DISTINCT leaf, masked, string_split(masked, ' ') AS tokens FROM lines WHERE n >= 5 AND leaf IN (SELECT leaf FROM several)),
{_ROUNDS},
templates AS ({' UNION ALL '.join(f"SELECT masked, '{k}|' || template AS template FROM told{k} WHERE member" for k in _OF_SQL)}),
placed AS (SELECT lines.*, CASE WHEN template IS NOT NULL THEN 't' || template ELSE 'm' || masked END AS k FROM lines LEFT JOIN templates USING (masked)),
seen AS (SELECT k, count(DISTINCT doc_id) AS docs, min(doc_id) AS first, max(n) AS n FROM placed WHERE n >= 3 GROUP BY 1),
marked AS (SELECT placed.*, coalesce(placed.n >= 3 AND seen.docs >= CASE WHEN seen.n >= 8 THEN 2 ELSE 5 END AND placed.doc_id <> seen.first, false) AS gone FROM placed LEFT JOIN seen USING (k))
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, t.n_lines, t.n_dropped FROM documents d JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
  count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_dropped FROM marked GROUP BY 1) t USING (doc_id)""",
    "op11_resampling": rf"""WITH {_CRC_TABLE},
words AS (SELECT true AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents UNION ALL
  SELECT false, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
buckets AS (SELECT w, ({_CRC.format('w')} % 10000)::INTEGER AS b FROM (SELECT DISTINCT w FROM words), crc),
counts AS (SELECT d, doc_id, b, count(*) AS n FROM words JOIN buckets USING (w) GROUP BY ALL),
sizes AS (SELECT coalesce(sum(n) FILTER (d), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT d), 0)::DOUBLE AS t FROM counts),
gains AS (SELECT b, floor(1000 * ln((coalesce(sum(n) FILTER (NOT d), 0)::DOUBLE + 1) * (any_value(s) + 10000) / ((coalesce(sum(n) FILTER (d), 0)::DOUBLE + 1) * (any_value(t) + 10000))))::BIGINT AS gain FROM counts, sizes GROUP BY 1),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM counts JOIN gains USING (b) WHERE d GROUP BY 1),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, r AS rank FROM scores LEFT JOIN (SELECT * FROM ranks WHERE r <= (SELECT 10 * count(*) // 100 FROM ranks)) USING (doc_id)""",
    "op12_conversation_trie": rf"""WITH {_CRC_TABLE},
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
heads AS (SELECT conv_id, ts, {_CRC.format('conv_id::VARCHAR')} % 4 AS h FROM own, crc),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (SELECT conv_id, len(ts) AS size, unnest(range(len(ts) + 1)) AS depth, ts FROM rebuilt),
prefixes AS (SELECT conv_id, size, depth, ts[1:depth] AS p FROM steps),
nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM prefixes GROUP BY p, depth),
parents AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
family AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN parents USING (p)),
subtrees AS (SELECT a.p, sum((v.n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens FROM family v JOIN prefixes a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY 1),
ends AS (SELECT p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefixes WHERE depth = size GROUP BY 1)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM family f JOIN subtrees s USING (p) LEFT JOIN ends e USING (p) LEFT JOIN nodes up ON f.depth > 0 AND up.depth = f.depth - 1 AND up.p = f.p[1:f.depth - 1]""",
}
