"""The queries that SQL can express, in DuckDB's SQL. Nothing here is taken from the operators."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sums
), weighed AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM ranked
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
         sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed WINDOW fill AS (ORDER BY cap::DOUBLE / weight, rank)
), targets AS (
  SELECT source, rank, source_size, least(cap::DOUBLE, weight * max(remains::DOUBLE / rest) OVER ()) AS target FROM levels
), goals AS (
  SELECT *, floor(target + 0.5)::BIGINT AS goal,
         sum(floor(target + 0.5)::BIGINT) OVER (ORDER BY rank)::BIGINT AS hi FROM targets
), whole AS (
  SELECT coalesce(max(hi), 0)::BIGINT AS words, count(*) AS sources, ((coalesce(max(hi), 0) + 127) // 128)::BIGINT AS n FROM goals
), points AS (
  SELECT j AS slot, ((j % 2147483648) * 1327217885 % 2147483648)::DOUBLE / 2147483648::DOUBLE * words::DOUBLE AS spot
  FROM (SELECT unnest(range(n)) AS j, words FROM whole)
), drawn AS (
  SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS block
  FROM points JOIN goals ON spot >= hi - goal AND spot < hi
), needs AS (
  SELECT g.rank, (g.goal + 127) // 128 AS need, (SELECT count(*) FROM drawn d WHERE d.rank = g.rank) AS got
  FROM goals g WHERE goal > 0
), slots AS (
  SELECT slot, d.rank, block FROM drawn d JOIN needs n ON d.rank = n.rank AND block < need
  UNION ALL
  SELECT w.n + block * w.sources + rank, rank, block
  FROM (SELECT rank, unnest(range(got, need)) AS block FROM needs) CROSS JOIN whole w
), placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target, t.goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM sized s JOIN goals t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(begins + size, goal) - begins)
        + greatest(0, least(source_size + begins + size, goal) - source_size - begins))::BIGINT AS taken,
       CASE WHEN size > 0 AND begins < goal THEN slot::BIGINT ELSE -1 END AS first_slot
FROM placed p LEFT JOIN slots s ON p.rank = s.rank AND p.begins // 128 = s.block
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, len(replace(replace(role, '\', '\\'), '<|', '<\|')) + len(replace(replace(text, '\', '\\'), '<|', '<\|'))
            + len('<|im_start|>') + len('<|im_end|>') + 2 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, false AS rewrites
FROM sized GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM split
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""

EXACT = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM digests
"""

VECTORS = """
WITH RECURSIVE whole AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM whole
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents
), lengths AS (
  SELECT r, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), items AS (
  SELECT row_number() OVER () AS q, item_id, {TERMS} AS terms FROM benchmark
), asked AS (
  SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS t FROM items) GROUP BY ALL
), tfs AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), totals
), damped AS (
  SELECT r, doc_id, 100 - 25 + ((25 * n * big_n) // big_l) AS m FROM lengths, totals
), scores AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN damped USING (r) GROUP BY ALL HAVING score > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), spots AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, k, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM counts WHERE k > 1 AND f >= 30
), inner_spots AS (
  SELECT lang, a, k, w, j, unnest(range(1, k - j + 2)) AS i
  FROM candidates, (SELECT unnest([2, 3]) AS j) WHERE j < k
), covered AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS g, max(a) AS longer FROM inner_spots GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covered v ON c.lang = v.lang AND c.g = v.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), cuts AS (
  SELECT lang, g, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.g, a, c, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
  FROM cuts JOIN counts h ON cuts.lang = h.lang AND cuts.head = h.g JOIN counts t ON cuts.lang = t.lang AND cuts.rest = t.g
), loosest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS place FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM loosest WHERE place = 1
)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def registered() -> dict[str, str]:
    return {
        "op4_vector_near_dedup": VECTORS,
        "op5_mix_sources": MIX,
        "op6_chat_format": CHAT,
        "op7_jaccard_join": JACCARD,
        "op9_exact_dedup": EXACT,
        "op11_lexical_search": SEARCH,
        "op12_phrase_collocations": PHRASES,
    }
