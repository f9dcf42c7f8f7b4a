"""Queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat_format import op5_chat_format
from .decontaminate import op1_decontaminate
from .hard_negatives import op11_hard_negatives
from .lm_score import op7_lm_score
from .media_ogg import op8_media_ogg
from .mixing import op12_mix
from .ngram_join import op3_ngram_join
from .paragraphs import op6_paragraphs
from .pii import op2_pii
from .prefix_trie import op13_prefix_trie
from .quality import op9_quality
from .warc import op4_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op4_warc": op4_warc,
    "op5_chat_format": op5_chat_format,
    "op6_paragraphs": op6_paragraphs,
    "op7_lm_score": op7_lm_score,
    "op8_media_ogg": op8_media_ogg,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mix": op12_mix,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Of the others, spans, votes, joins, searches and scores are beyond SQL or too slow in it; tests/llm has their
#: brute-force versions.
SQL: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS first, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.h = p.h""",
    "op5_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, '<s>[' || CASE WHEN role = 'user' THEN 'INST' ELSE 'role:' || replace(replace(replace(role, '%', '%25'), ']', '%5D'), '<', '%3C') END || '] '
|| regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\]|</?SYS>>|role:)', '\1\\\2', 'g') || '</s>' AS out FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(out)) AS BIGINT) AS formatted_chars, true AS identical FROM r GROUP BY conv_id""",
    "op11_hard_negatives": """WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op12_mix": r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (total - 3.0::DOUBLE * (sum(source_size) OVER w - source_size)) / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level FROM o WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM f WHERE weight * level <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(weight * l.level, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target FROM s, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
w AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - repeats * source_size AS want FROM u),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY source, key) AS here, count(*) OVER (PARTITION BY source, key) AS n FROM k)
SELECT doc_id, size, source_size, target, CAST(repeats * size + CASE WHEN upto <= want THEN size WHEN upto - here < want THEN (want - (upto - here)) // n ELSE 0 END AS BIGINT) AS taken
FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source""",
    "op13_prefix_trie": """WITH RECURSIVE poly(c, k, v) AS (SELECT c, 0, c FROM range(256) t(c) UNION ALL SELECT c, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY c) AS crc FROM poly WHERE k = 8),
rows AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': digest, 'b': bytes} ORDER BY turn NULLS FIRST, substr(digest, 1, 32)) AS turns FROM rows GROUP BY conv_id),
h AS (SELECT own.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]))) % 9 AS h FROM own, crc),
full_ AS (SELECT h.conv_id, list_concat(coalesce(base.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS len, d, list_transform(turns[1:d], lambda t: t.d) AS path, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS bytes FROM full_, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.path = n.path),
up AS (SELECT path[1:k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, LATERAL (SELECT unnest(range(0, depth + 1)) AS k) GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN up ON up.path = m.path LEFT JOIN n a ON m.depth > 0 AND a.path = m.path[1:m.depth - 1]""",
}
