"""DuckDB SQL of the job queries (``jobs``), as far as SQL can say what they give."""

from __future__ import annotations

from .oracles import _BOUNDS, _BUDGET, _COUNTS, _DOCS, _EXAMPLES, _INDEXED, _LOGITS, _OFFSETS, _SPLIT, ORACLE_SQL, _packed

_AFTER = f"{_DOCS}, {_packed('after', 'docs', ['source'], 'doc_id')}"
_NUMBER = "CASE WHEN shard_index < 10000 THEN lpad(shard_index::VARCHAR, 4, '0') ELSE shard_index::VARCHAR END"
_FILE = f"source || '/' || source || '_' || {_NUMBER} || '.bin'"
_PAIRS = r"""halves AS (SELECT item_id, substr(text, 1, length(text) // 2) || CASE WHEN item_id % 2 = 0 THEN '  ' ELSE '' END AS c, substr(text, length(text) // 2 + 1) AS t FROM benchmark),
heads AS (SELECT item_id, regexp_replace(c, '\s+$', '') AS head, substr(c, length(regexp_replace(c, '\s+$', '')) + 1) || t AS tail FROM halves)"""
_CODES = "coalesce(list_sum(list_transform(range(1, length({0}) + 1), lambda k: unicode(substr({0}, k::INT, 1)) % 256)), 0)::BIGINT"
#: A target that is the code point after the last one, and one that is not (logits of 2 and 0).
_RIGHT, _WRONG = "2.0 - ln(exp(2.0) + 255.0)", "-ln(exp(2.0) + 255.0)"
_SERVED = f"""{_COUNTS}, totals AS (SELECT source, sum(windows)::BIGINT AS w FROM counts GROUP BY source), u(source, k) AS (VALUES ('assistant', 12), ('system', 3), ('user', 9)),
d AS (SELECT source, w, 3000 * k AS n FROM totals JOIN u USING (source))"""
_MIXED = f"WITH {_SERVED} SELECT source, n::BIGINT AS served, least(n, w)::BIGINT AS windows, greatest(n // w, 1)::BIGINT AS fewest, ((n + w - 1) // w)::BIGINT AS most FROM d"

_BATCHED = """WITH RECURSIVE edges(edge) AS (SELECT 512 UNION ALL SELECT floor(edge / 1.1)::INT FROM edges WHERE floor(edge / 1.1) > 0),
sized AS (SELECT doc_id, s AS target_start, least(512, l - s + 1)::INT AS n FROM (SELECT doc_id, coalesce(length(text), 0) + 1 AS l FROM documents), unnest(range(1, l, 511)) AS u(s)),
banded AS (SELECT n, min(edge)::INT AS band FROM (SELECT DISTINCT n FROM sized), edges WHERE edge >= n GROUP BY n),
placed AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY doc_id, target_start) - 1 AS spot, greatest(8192 // band, 1) AS r FROM sized JOIN banded USING (n)),
batched AS (SELECT doc_id, target_start, n, band, (spot // r)::BIGINT AS batch, (spot % r)::BIGINT AS place FROM placed)"""
_BLOCKS = """WITH vectors AS (SELECT vec_id // 256 AS b, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
parts AS (SELECT b, v, NOT (vec_id % 97 = 0 AND i = 1) AS ok FROM (SELECT b, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM vectors)),
held AS (SELECT b, count(*) AS elements, count(*) FILTER (NOT ok) AS nonfinite, min(v) FILTER (ok) AS low, max(v) FILTER (ok) AS high, sum(v) FILTER (ok) AS total FROM parts GROUP BY b),
sized AS (SELECT *, (SELECT count(*) FROM vectors WHERE vectors.b = held.b) AS n FROM held),
report AS (SELECT 'block.' || b || '.weight' AS name, elements, nonfinite, low, high,
  list_filter([CASE WHEN b % 5 = 0 THEN 'unexpected' END, CASE WHEN b % 5 <> 0 AND n <> 256 THEN 'shape [' || n || ', ' || elements // n || '], not [256, 64]' END, CASE WHEN nonfinite > 0 THEN nonfinite || ' values are not finite' END], lambda e: e IS NOT NULL) AS errors FROM sized
  UNION ALL SELECT 'block.' || b || '.bias', NULL, NULL, NULL, NULL, ['missing'] FROM sized WHERE b % 5 = 0)"""


def _grouped(n: str, width: int) -> str:
    """A number below 10^12 with commas, right-aligned."""
    parts = [f"CASE WHEN {n} >= {10**k} THEN ',' || lpad(({n} // {10 ** (k - 3)} % 1000)::VARCHAR, 3, '0') ELSE '' END" for k in (9, 6, 3)]
    head = f"({n} // CASE WHEN {n} >= 1000000000 THEN 1000000000 WHEN {n} >= 1000000 THEN 1000000 WHEN {n} >= 1000 THEN 1000 ELSE 1 END)::BIGINT::VARCHAR"
    return f"lpad({head} || {' || '.join(parts)}, {width}, ' ')"


_RANGES = f"""{_COUNTS}, {_BOUNDS}, filled AS (SELECT *, first_window AS low FROM counts WHERE windows > 0)"""


def _permuted(n: str, key: str, rounds: int = 4) -> str:
    """One step of the keyed permutation of p in ``ranks`` (x and y over rows and columns of a rectangle)."""
    made = "SELECT *, p // columns AS x, p % columns AS y FROM here"
    for r in range(1, rounds + 1):
        made = f"SELECT * REPLACE ((x + ('0x' || substr(md5({key} || '|{r}|x|' || y), 1, 12))::BIGINT % n_rows) % n_rows AS x) FROM ({made})"
        made = f"SELECT * REPLACE ((y + ('0x' || substr(md5({key} || '|{r}|y|' || x), 1, 12))::BIGINT % columns) % columns AS y) FROM ({made})"
    return f"SELECT source, pass, rank, {n}, n_rows, columns, x * columns + y AS p FROM ({made})"


_KEYED = f"""WITH RECURSIVE {_COUNTS}, totals AS (SELECT source, sum(windows)::BIGINT AS n, ceil(sqrt(sum(windows)))::BIGINT AS n_rows FROM counts GROUP BY source HAVING sum(windows) > 0),
ranks AS (SELECT source, u.pass, r.rank, n, n_rows, (n + n_rows - 1) // n_rows AS columns FROM totals, (VALUES (0), (1)) u(pass), unnest(range(n)) AS r(rank)),
walk AS ({_permuted("n", "'42|' || source || '|' || pass").replace("FROM here", "FROM (SELECT *, rank AS p FROM ranks)")}
  UNION ALL {_permuted("n", "'42|' || source || '|' || pass").replace("FROM here", "FROM walk WHERE p >= n")})
SELECT source, pass::BIGINT AS pass, rank, p AS window_index, true AS found_again FROM walk WHERE p < n"""

JOB_SQL: dict[str, str] = {
    "tokenize_job": f"""WITH RECURSIVE {_AFTER} SELECT count(*) AS documents, (SELECT count(*) FROM documents) - count(*) AS skipped, sum(n_tokens)::BIGINT AS total_tokens,
      (SELECT sum(m)::BIGINT FROM (SELECT max(shard_index) + 1 AS m FROM packed GROUP BY source)) AS shards FROM packed""",
    "written_shards": f"""WITH RECURSIVE {_AFTER} SELECT {_FILE} AS path, source, shard_index, 2 * sum(n_tokens)::BIGINT AS bytes, sum(n_tokens)::BIGINT AS tokens, count(*) AS eos_tokens, true AS ends_with_eos, NULL::VARCHAR AS error
      FROM packed GROUP BY source, shard_index""",
    "shard_round_trip": f"WITH {_INDEXED} SELECT n.source, n.doc_index, length(d.text)::BIGINT AS n_chars, sha256(d.text) AS sha256 FROM numbered n JOIN documents d ON d.doc_id = n.doc_id",
    "decoded_samples": f"""WITH RECURSIVE {_AFTER}, firsts AS (SELECT source, shard_index, min(doc_id) AS doc_id FROM packed GROUP BY source, shard_index)
      SELECT {_FILE.replace("source", "f.source").replace("shard_index", "f.shard_index")} AS path, strlen(d.text)::BIGINT AS n_tokens, substr(d.text, 1, 40) AS sample FROM firsts f JOIN documents d ON d.doc_id = f.doc_id""",
    "checked_shards": f"""WITH RECURSIVE {_AFTER}, per AS (SELECT source, max(shard_index) + 1 AS shards, sum(n_tokens)::BIGINT AS tokens, count(*) AS ends FROM packed GROUP BY source),
      lines AS (SELECT row_number() OVER (ORDER BY source) - 1 AS line, rpad(source, 24, ' ') || {_grouped('shards', 8)} || ' shards' || {_grouped('tokens', 18)} || ' tokens' || {_grouped('ends', 14)} || ' ends' AS text FROM per)
      SELECT line::INT AS line, text FROM lines UNION ALL SELECT ((SELECT count(*) FROM per) + n)::INT, text FROM (VALUES (0, '0 errors'), (1, '0 warnings'), (2, 'RESULT: PASSED')) AS v(n, text)""",
    "nothing_to_check": "SELECT * FROM (VALUES (0, 0::BIGINT, 'root directory does not exist', false), (1, 0::BIGINT, 'no token files found', false)) AS v(folder, files, error, has_totals)",
    "unreadable_shards": """SELECT 'region_' || lpad(r_regionkey::VARCHAR, 4, '0') || '.bin' AS path, r_regionkey::BIGINT AS bytes,
      CASE WHEN r_regionkey = 0 THEN 'empty file' WHEN r_regionkey % 2 = 1 THEN 'file size is not a multiple of two bytes' END AS error FROM region""",
    "split_files": f"""WITH RECURSIVE {_SPLIT}, {_packed('before', 'parted', ['split', 'source'], 'doc_index')}
      SELECT split || '/' || {_FILE} AS path, 2 * sum(n_tokens)::BIGINT AS bytes, NULL::VARCHAR AS error FROM packed GROUP BY split, source, shard_index""",
    "split_job": f"WITH {_DOCS} SELECT source, count(*) AS documents, count(*) AS assigned, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source",
    "vocabulary": "SELECT * FROM (VALUES ('bytes', 259, 1, 2, 0), ('points', 256, 1, 2, 2)) AS v(name, vocab_size, bos, eos, pad)",
    "replies": "SELECT conv_id, turn, (CASE WHEN turn % 3 = 0 THEN length('[EOS]') ELSE length(text) END)::BIGINT AS n_chars FROM conversations",
    "encoded_pairs": f"WITH {_PAIRS} SELECT item_id, length(head)::BIGINT AS n_context, length(tail)::BIGINT AS n_continuation, {_CODES.format('head')} AS context_sum, {_CODES.format('tail')} AS continuation_sum FROM heads",
    "request_batches": f"{_BATCHED} SELECT * FROM batched",
    "request_padding": f"""{_BATCHED}, each AS (SELECT band, batch, count(*) AS r, sum(n) AS t, count(*) * max(n) AS p FROM batched GROUP BY band, batch)
      SELECT band, count(*) AS batches, sum(r)::BIGINT AS requests, sum(t)::BIGINT AS tokens, sum(p)::BIGINT AS padded_tokens, max(p)::BIGINT AS largest FROM each GROUP BY band""",
    "tensor_values": f"{_BLOCKS} SELECT 'block.' || b || '.weight' AS name, elements, elements AS n, round(total, 4) AS total FROM sized",
    "tensor_headers": f"{_BLOCKS} SELECT 'F32' AS dtype, true AS decays, count(*) AS tensors, sum(elements)::BIGINT AS parameters FROM sized",
    "checkpoint_report": f"{_BLOCKS} SELECT * REPLACE (array_to_string(errors, '; ') AS errors) FROM report",
    "checkpoint_summary": f"{_BLOCKS} SELECT sum(len(errors)) = 0 AS passed, count(elements) AS tensors, sum(elements)::BIGINT AS parameters, bool_and(coalesce(nonfinite, 0) = 0) AS weights_finite, sum(len(errors))::BIGINT AS errors FROM report",
    "scored_pairs": f"""WITH {_PAIRS}, each AS (SELECT item_id, unicode(substr(head || tail, i::INT, 1)) % 256 = (unicode(substr(head || tail, (i - 1)::INT, 1)) + 1) % 256 AS hit FROM heads, unnest(range(length(head) + 1, length(head || tail) + 1)) AS u(i))
      SELECT item_id, round(sum(CASE WHEN hit THEN {_RIGHT} ELSE {_WRONG} END), 6) AS log_likelihood, bool_and(hit) AS is_greedy FROM each GROUP BY item_id""",
    "rolling_scores": f"""WITH each AS (SELECT item_id, unicode(substr(text, i::INT, 1)) % 256 = (CASE WHEN i = 1 THEN 2 ELSE unicode(substr(text, (i - 1)::INT, 1)) END + 1) % 256 AS hit FROM benchmark, unnest(range(1, length(text) + 1)) AS u(i))
      SELECT item_id, round(sum(CASE WHEN hit THEN {_RIGHT} ELSE {_WRONG} END), 6) AS log_likelihood FROM each GROUP BY item_id""",
    "generated_texts": """WITH c AS (SELECT item_id, unicode(right(text, 1)) % 256 AS c FROM benchmark),
      made AS (SELECT item_id, array_to_string(list_transform(list_filter(list_transform(range(1, 7), lambda k: ((c + k) % 256)::INT), lambda x: x NOT IN (1, 2)), lambda x: chr(x)), '') AS t FROM c)
      SELECT item_id, split_part(split_part(t, 'e', 1), '|', 1) AS text FROM made""",
    "generated_tokens": """WITH c AS (SELECT item_id, unicode(right(text, 1)) % 256 AS c FROM benchmark),
      made AS (SELECT item_id, list_transform(range(1, 7), lambda k: ((c + k) % 256)::INT) AS t FROM c)
      SELECT item_id, array_to_string(CASE WHEN list_position(t, 52) > 0 THEN t[1:list_position(t, 52)] ELSE t END, ',') AS tokens FROM made""",
    "sampled_tokens": """WITH c AS (SELECT item_id, unicode(right(text, 1)) % 256 AS c FROM benchmark)
      SELECT item_id, array_to_string(list_transform(range(1, 5), lambda k: ((c + k) % 256)::INT), ',') AS tokens FROM c""",
    "parameter_names": "SELECT p_partkey, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'module.' ELSE '' END || p_brand AS other FROM part",
    "first_scanned": f"WITH {_EXAMPLES} SELECT conv_id, status, n_tokens, assistant_tokens FROM examples WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 40)",
    "artifact_examples": f'WITH {_OFFSETS} SELECT example_index, start, start + n_tokens AS "end", id_sum, assistant_tokens AS mask_sum FROM kept',
    "flat_examples": f'WITH {_OFFSETS} SELECT example_index, start, start + n_tokens AS "end", id_sum, assistant_tokens AS mask_sum FROM kept',
    "artifact_metadata": f"""WITH {_EXAMPLES} SELECT 'points' AS tokenizer, 2048::BIGINT AS max_length, count(*) AS scanned, count(*) FILTER (status = 'retained') AS retained, count(*) FILTER (status = 'dropped') AS dropped,
      count(*) FILTER (status = 'invalid') AS invalid, coalesce(sum(n_tokens) FILTER (status = 'retained'), 0)::BIGINT AS total_tokens, coalesce(sum(assistant_tokens) FILTER (status = 'retained'), 0)::BIGINT AS assistant_tokens FROM examples""",
    "blob_texts": """SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS has_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 5 = 0 THEN '' ELSE 'text of content/' || doc_id END AS text,
      doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0 AS failed FROM documents""",
    "ensured_quotas": """WITH w(source, weight) AS (VALUES ('a', 0.9::DOUBLE), ('b', 0.05::DOUBLE), ('c', 0.05::DOUBLE)), s(n) AS (VALUES (3), (5), (10), (20), (40)),
      base AS (SELECT n, source, weight * n AS raw, floor(weight * n) AS low FROM s, w),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY low - raw, source) AS k, n - sum(low) OVER (PARTITION BY n) AS spare FROM base),
      got AS (SELECT n, source, low + CASE WHEN k <= spare THEN 1 ELSE 0 END AS q FROM ranked), z AS (SELECT n, count(*) FILTER (q = 0) AS starved FROM got GROUP BY n)
      SELECT n::INT AS batch_size, source, (CASE WHEN q = 0 THEN 1 WHEN source = 'a' THEN q - starved ELSE q END)::INT AS quota FROM got JOIN z USING (n)""",
    "cycle_labels": """WITH w(source, k) AS (VALUES ('assistant', 12), ('system', 3), ('user', 9))
      SELECT c AS cycle, source, k::BIGINT AS labels, (c * k)::BIGINT AS first_draw, ((c + 1) * k - 1)::BIGINT AS last_draw FROM w, unnest(range(100)) AS u(c)""",
    "drawn_ranks": f"""WITH {_SERVED} SELECT source, p AS pass, least(w, n - p * w)::BIGINT AS draws, least(w, n - p * w)::BIGINT AS ranks, (least(w, n - p * w) - 1)::BIGINT AS last_rank
      FROM d, unnest(range((n + w - 1) // w)) AS u(p)""",
    "pass_permutations": f"""WITH {_SERVED} SELECT source, p AS pass, w AS windows, 0::BIGINT AS least_rank, w - 1 AS last_rank, w AS different_rank, 0::BIGINT AS least_window_index, w - 1 AS last_window_index, w AS different_window_index
      FROM d, unnest(range(2)) AS u(p)""",
    "mixture_windows": _MIXED,
    "hashed_batches": _MIXED,
    "first_batches": f"SELECT sample_index, batch_id, source, window_index FROM ({ORACLE_SQL['full_split_samples']}) WHERE batch_id < 3",
    "epoch_positions": "SELECT count(*) AS documents, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS places FROM documents",
    "observed_rows": f"WITH {_DOCS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents) - count(*) AS blank FROM docs",
    "step_tokens": "SELECT p_partkey, (p_size * 128)::BIGINT AS tokens FROM part",
    "stream_budget": f"WITH RECURSIVE {_DOCS}, {_BUDGET}, {_packed('after', 'kept', ['source'], 'doc_id')} SELECT source, doc_id, n_tokens, rn - 1 AS doc_index, shard_index FROM packed",
    "stream_examples": f'WITH {_OFFSETS} SELECT conv_id, example_index, start, start + n_tokens AS "end" FROM kept',
    "rmsnorm_weighted": """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding) + 1e-6) AS s FROM embeddings)
      SELECT vec_id, (i - 1)::INT AS i, round(embedding[i]::DOUBLE / s * (((i - 1) % 3 + 1)::DOUBLE / 2), 6) AS x FROM n, unnest(range(1, len(embedding) + 1)) AS u(i)""",
    "swiglu": f"""WITH {_LOGITS}, n AS (SELECT vec_id, count(*) AS n FROM logits GROUP BY vec_id)
      SELECT a.vec_id, a.token AS i, round(a.logit / (1.0 + exp(-a.logit)) * b.logit, 9) AS x FROM logits a JOIN n USING (vec_id) JOIN logits b ON b.vec_id = a.vec_id AND b.token = n.n - 1 - a.token""",
    "keyed_pass_order": _KEYED,
    "keyed_batches": _MIXED,
    "sample_lookup": f"""WITH {_RANGES}, ask AS (SELECT doc_id, doc_id * 7919 % (SELECT sum(windows)::BIGINT FROM counts) AS sample_index FROM documents),
        placed AS (SELECT f.source, f.shard_index, b.source_id, (b.first_sample + f.low)::BIGINT AS low FROM filled f JOIN bounds b USING (source))
      SELECT doc_id, sample_index::BIGINT AS sample_index, source_id, source, shard_index, (sample_index - low)::BIGINT AS window_index, ((sample_index - low) * 65)::BIGINT AS start FROM ask ASOF JOIN placed ON sample_index >= low""",
    "window_lookup": f"""WITH {_RANGES}, ask AS (SELECT doc_id, b.source, (doc_id * 104729 % b.windows)::BIGINT AS source_window FROM documents d JOIN (SELECT * FROM bounds JOIN totals USING (source)) b ON b.source_id = d.doc_id % 3)
      SELECT doc_id, a.source, source_window, shard_index, (source_window - low)::BIGINT AS window_index, ((source_window - low) * 65)::BIGINT AS start FROM ask a ASOF JOIN filled f ON a.source = f.source AND source_window >= low""",
    "stream_stop": f"WITH RECURSIVE {_DOCS}, {_BUDGET}, {_packed('after', 'kept', ['source'], 'doc_id')} SELECT source, doc_id, n_tokens, rn - 1 AS doc_index, shard_index FROM packed",
    "streamed_shards": f"""WITH RECURSIVE {_AFTER}, sums AS (SELECT doc_id, list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT + 3)) + 2 AS s FROM documents WHERE text IS NOT NULL)
      SELECT {_FILE} AS path, sum(n_tokens)::BIGINT AS tokens, sum(s.s)::BIGINT AS id_sum FROM packed JOIN sums s USING (doc_id) GROUP BY source, shard_index""",
    "streamed_mixture": _MIXED,
}
JOB_SQL["scored_batches"] = JOB_SQL["scored_pairs"]
