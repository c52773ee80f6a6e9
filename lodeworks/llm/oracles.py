"""DuckDB SQL of the operators' queries, as far as SQL expresses them."""

from __future__ import annotations

from . import decontam, divergence, search

LINES = r"""
WITH lines AS (SELECT doc_id, u.i, string_split(coalesce(text, ''), chr(10))[u.i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
     keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
     repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
     judged AS (SELECT l.*, r.keeper IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM keyed l LEFT JOIN repeated r ON r.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     windows AS (SELECT doc_id, u.i, array_to_string(w[u.i:u.i + 34], ' ') AS s FROM w, unnest(range(1, len(w) - 33)) AS u(i)),
     hits AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
     gone AS (SELECT DISTINCT doc_id, i + u.k AS i FROM hits, unnest(range(0, 35)) AS u(k)),
     words AS (SELECT w.doc_id, u.i, w.w[u.i] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
     kept AS (SELECT a.doc_id, a.i, a.word, g.i IS NOT NULL AS gone FROM words a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i),
     told AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_words, 0) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""

EMBEDDINGS = r"""
WITH RECURSIVE able AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM able a, able b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
     reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
     roots AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
     counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN roots r ON r.x = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op5_benchmark_decontamination": decontam.ORACLE_SQL,
    "op7_line_dedup": LINES,
    "op9_substring_dedup": SUBSTRINGS,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_ranked_search": search.ORACLE_SQL,
}
