"""DuckDB SQL for the operators that SQL can express; quadratic in a group's size, so for the smaller tables only."""

from __future__ import annotations

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
c AS (SELECT n, min(c) AS c FROM r GROUP BY 1), d AS (SELECT a, count(*) AS k FROM p GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.n = vec_id LEFT JOIN d ON d.a = vec_id"""

JACCARD_JOIN = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS gram FROM s), k AS (SELECT doc_id, len(s) AS n FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM i JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) * (1 - 1e-12)),
r AS (SELECT doc_id AS n, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
c AS (SELECT n, min(c) AS c FROM r GROUP BY 1), d AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
SELECT doc_id, c.c AS class_id, coalesce(links, 0) AS n_links FROM documents JOIN c ON c.n = doc_id LEFT JOIN d ON d.a = doc_id"""

#: A text is escaped only where a control string or something like an escaped one is in it; each gets one character more.
_CONTROL = r"[<\[]\\*(?:s>|/s>|INST\]|/INST\]|OUT\]|/OUT\]|SYS\]|/SYS\]|ROLE |/ROLE\])"
CHAT = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, CASE role WHEN 'user' THEN length('<s>[INST] ') + length(' [/INST]') WHEN 'assistant' THEN length('[OUT] ') + length(' [/OUT]</s>')
      WHEN 'system' THEN length('<s>[SYS] ') + length(' [/SYS]</s>') ELSE length('[ROLE ] ') + length(role) + length(' [/ROLE]</s>') END
    + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY 1"""

HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

FILL_MIDDLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

SQL = {"op2_embedding_dedup": EMBEDDING_DEDUP, "op8_jaccard_join": JACCARD_JOIN, "op9_chat_formatting": CHAT, "op11_hard_negatives": HARD_NEGATIVES, "op13_fill_middle": FILL_MIDDLE}
