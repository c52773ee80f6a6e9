"""DuckDB SQL of the registered queries (those that SQL can express)."""

from __future__ import annotations

_DOCS = """docs AS (SELECT doc_id, source, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens FROM documents
  WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\x{1c}-\\x{1f}]'))"""

_INDEXED = f"""{_DOCS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_index FROM docs)"""

_SPLIT = f"""{_INDEXED}, parted AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5('42:' || source || ':' || CAST(doc_index AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.05
  THEN 'val' ELSE 'train' END AS split FROM numbered)"""


def _packed(rule: str, rows: str, by: list[str], order: str, cap: int = 20_000) -> str:
    """Greedy packing as a recursion over the documents of a group, one after another."""
    keys = ", ".join(by)
    same = " AND ".join(f"d.{k} = p.{k}" for k in by)
    carried = ", ".join(f"d.{k}" for k in by)
    if rule == "after":
        opens = f"p.held >= {cap}"
    else:
        opens = f"p.held + d.n_tokens > {cap}"
    return f"""ranked AS (SELECT {keys}, {order}, n_tokens, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {rows}),
packed AS (SELECT {keys}, {order}, n_tokens, rn, n_tokens AS held, CAST(0 AS BIGINT) AS shard_index FROM ranked WHERE rn = 1
  UNION ALL
  SELECT {carried}, d.{order}, d.n_tokens, d.rn, CASE WHEN {opens} THEN d.n_tokens ELSE p.held + d.n_tokens END,
         p.shard_index + CASE WHEN {opens} THEN 1 ELSE 0 END
  FROM packed p JOIN ranked d ON {same} AND d.rn = p.rn + 1)"""


_BUDGET = """kept AS (SELECT doc_id, source, n_tokens FROM (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs) WHERE before < 100000)"""

_PIECES = """pieces AS (SELECT role AS source, conv_id // 20 AS shard_index, conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND text <> '')"""
_TOKENS = f"""{_PIECES}, letters AS (SELECT source, shard_index, conv_id, turn, i, unicode(substr(text, i::INT, 1)) % 256 AS token
  FROM pieces, unnest(range(1, length(text) + 1)) AS u(i)),
tokens AS (SELECT source, shard_index, token, row_number() OVER (PARTITION BY source, shard_index ORDER BY conv_id, turn, i) - 1 AS position FROM letters)"""
_SIZES = f"""{_PIECES}, sizes AS (SELECT source, shard_index, CAST(sum(length(text)) AS BIGINT) AS tokens FROM pieces GROUP BY ALL)"""
_COUNTS = f"""{_SIZES}, counts AS (SELECT source, shard_index, tokens, tokens // 65 AS windows,
  CAST(coalesce(sum(tokens // 65) OVER (PARTITION BY source ORDER BY shard_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_window,
  sum(tokens // 65) OVER (PARTITION BY source) > 0 AS has_any FROM sizes)"""
_BOUNDS = """totals AS (SELECT source, CAST(sum(windows) AS BIGINT) AS windows FROM counts GROUP BY source),
bounds AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS source_id,
  CAST(sum(windows) OVER (ORDER BY source) - windows AS BIGINT) AS first_sample, CAST(sum(windows) OVER (ORDER BY source) AS BIGINT) AS end_sample FROM totals)"""
_SCAN = f"""{_TOKENS}, scanned AS (SELECT source, shard_index, count(*) * 2 AS bytes, count(*) AS tokens, count(*) FILTER (token = 46) AS eos_tokens,
  min(token)::INT AS min_token_id, max(token)::INT AS max_token_id, arg_max(token, position) = 46 AS ends_with_eos FROM tokens GROUP BY ALL),
noted AS (SELECT *, CASE WHEN max_token_id >= 245 THEN 'ids ' || min_token_id || ' to ' || max_token_id || ' do not fit vocabulary size 245' END AS error,
  CASE WHEN eos_tokens = 0 THEN 'no end token in it' END AS warning, source || '_' || CASE WHEN shard_index < 10000 THEN lpad(shard_index::VARCHAR, 4, '0') ELSE shard_index::VARCHAR END || '.bin' AS path FROM scanned)"""
_GAPS = """present AS (SELECT source, shard_index, tokens, eos_tokens FROM noted),
span AS (SELECT source, min(shard_index) AS a, max(shard_index) AS b, count(*) AS shards, sum(tokens)::BIGINT AS tokens, sum(eos_tokens)::BIGINT AS eos_tokens FROM present GROUP BY source),
gaps AS (SELECT s.source, u.i AS shard_index FROM span s, unnest(range(s.a, s.b + 1)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.source = s.source AND p.shard_index = u.i)),
ranges AS (SELECT source, shard_index + 1 AS a, lead(shard_index) OVER (PARTITION BY source ORDER BY shard_index) - 1 AS b FROM present),
listed AS (SELECT source, string_agg(CASE WHEN b = a THEN a::VARCHAR WHEN b = a + 1 THEN a || ',' || b ELSE a || '-' || b END, ',' ORDER BY a) AS missing FROM ranges WHERE b >= a GROUP BY source)"""
_TILES = f"""{_TOKENS}, whole AS (SELECT source, shard_index, position // 65 AS window_index, position % 65 AS p, token FROM tokens),
tiles AS (SELECT source, shard_index, window_index, max(token) FILTER (p = 0) AS x_first, sum(token) FILTER (p < 64)::BIGINT AS x_sum, max(token) FILTER (p = 64) AS y_last,
  sum(token) FILTER (p > 0)::BIGINT AS y_sum, sum(token)::BIGINT AS token_sum FROM whole GROUP BY ALL HAVING count(*) = 65)"""

_TURNS = r"""named AS (SELECT conv_id, turn, role, text, CASE regexp_replace(lower(role), '^\s+|\s+$', '', 'g') WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' WHEN 'human' THEN 'user'
  WHEN 'assistant' THEN 'assistant' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' END AS r,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
steps AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM named)"""


def _judged(end: str) -> str:
    return rf"""{_TURNS},
marked AS (SELECT conv_id, i, n, r, before, CASE WHEN role IS NULL OR NOT regexp_matches(role, '\S') THEN 'turn ' || i || ': role missing'
    WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'turn ' || i || ': content missing' WHEN r IS NULL THEN 'turn ' || i || ': role unknown' END AS broken,
  CASE WHEN i > 0 AND r <> CASE before WHEN 'user' THEN 'assistant' ELSE 'user' END THEN r || ' after ' || before END AS wrong FROM steps),
judged AS (SELECT conv_id, count(*) AS turns, CASE WHEN count(broken) > 0 THEN arg_min(broken, i) FILTER (broken IS NOT NULL)
    WHEN arg_min(r, i) = 'assistant' THEN 'assistant speaks first' WHEN arg_max(r, i) <> '{end}' THEN 'last turn is not {end}'
    WHEN count(wrong) > 0 THEN arg_min(wrong, i) FILTER (wrong IS NOT NULL) END AS error FROM marked GROUP BY conv_id)"""


_MADE = """parts AS (SELECT s.conv_id, s.i, s.r, length(s.r) + 2 AS p, length(s.text) + 1 + CASE WHEN s.r = 'assistant' THEN 1 ELSE 0 END AS b,
  list_sum(list_transform(range(1, length(s.r) + 1), lambda k: unicode(substr(s.r, k::INT, 1)) % 256)) + 58 + 32 AS ps,
  coalesce(list_sum(list_transform(range(1, length(s.text) + 1), lambda k: unicode(substr(s.text, k::INT, 1)) % 256)), 0) + 10 + CASE WHEN s.r = 'assistant' THEN 2 ELSE 0 END AS bs
  FROM steps s JOIN judged j USING (conv_id) WHERE j.error IS NULL),
made AS (SELECT conv_id, CAST(1 + sum(p + b) AS BIGINT) AS n_tokens, CAST(coalesce(sum(b) FILTER (r = 'assistant'), 0) AS BIGINT) AS assistant_tokens, CAST(1 + sum(ps + bs) AS BIGINT) AS id_sum FROM parts GROUP BY conv_id)"""
_EXAMPLES = f"""{_judged("assistant")}, {_MADE}, examples AS (SELECT j.conv_id, CASE WHEN j.error IS NOT NULL THEN 'invalid' WHEN m.n_tokens > 2048 THEN 'dropped' ELSE 'retained' END AS status,
  m.n_tokens, m.assistant_tokens, m.id_sum FROM judged j LEFT JOIN made m USING (conv_id))"""
_OFFSETS = f"""{_EXAMPLES}, kept AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS example_index, CAST(sum(n_tokens) OVER (ORDER BY conv_id) - n_tokens AS BIGINT) AS start FROM examples WHERE status = 'retained')"""

_LOSSES = f"""{_DOCS}, losses AS (SELECT doc_id, source, CAST(doc_id * 37 % 1000 AS DOUBLE) / 250.0 AS loss, doc_id % 3 = 0 AS correct FROM docs)"""


def _summary(loss: str, hits: str, n: str) -> str:
    mean = f"coalesce({loss}, 0.0) / CAST(greatest({n}, 1) AS DOUBLE)"
    return f"""round({mean}, 6) AS loss, round(exp(least({mean}, 20.0)), 6) AS perplexity, round(CAST(coalesce({hits}, 0) AS DOUBLE) / CAST(greatest({n}, 1) AS DOUBLE), 6) AS token_accuracy, CAST({n} AS BIGINT) AS tokens"""


_LOGITS = """logits AS (SELECT vec_id, CAST(i - 1 AS INT) AS token, CAST(embedding[i] AS DOUBLE) AS logit FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"""
_SOFT = f"""{_LOGITS}, tops AS (SELECT vec_id, max(logit) AS top FROM logits GROUP BY vec_id)"""
_REQUESTS = r"""requests AS (SELECT item_id, list_prepend(2, list_transform(range(1, length(text) + 1), lambda k: (unicode(substr(text, k::INT, 1)) % 256)::INT)) AS ids FROM benchmark)"""
_PARAMS = """params AS (SELECT p_partkey, 'layers.' || p_size || CASE p_partkey % 3 WHEN 0 THEN '.bias' WHEN 1 THEN '.weight' ELSE '.embedding' END AS name, p_partkey % 3 AS dimensions, p_size AS elements, p_partkey % 5 > 0 AS trainable FROM part)"""
_WEIGHTS = "w(source, weight) AS (VALUES ('books', 0.25), ('code', 0.125), ('web', 0.625))"


#: The least whole number of batches that gives the smallest weight a place for each source.
_UNIT = "(ceil(ceil((SELECT count(*) / min(weight::DOUBLE) FROM w)) / b.batch_size) * b.batch_size)::INT"


def _quota(sizes: str) -> str:
    return f"""{_WEIGHTS}, s(batch_size) AS (VALUES {sizes}), base AS (SELECT batch_size, source, CAST(weight AS DOUBLE) * batch_size AS raw, floor(CAST(weight AS DOUBLE) * batch_size) AS low FROM s, w),
ordered AS (SELECT *, row_number() OVER (PARTITION BY batch_size ORDER BY low - raw, source) AS k, batch_size - sum(low) OVER (PARTITION BY batch_size) AS spare FROM base)"""


ORACLE_SQL: dict[str, str] = {
    "nonblank_documents": f"WITH {_DOCS} SELECT doc_id, source, n_tokens - 1 AS n_bytes FROM docs",
    "token_counts": f"""WITH {_DOCS} SELECT a.source, count(d.doc_id) AS documents, count(*) - count(d.doc_id) AS skipped, CAST(coalesce(sum(d.n_tokens), 0) AS BIGINT) AS total_tokens, max(d.n_tokens) AS longest
      FROM documents a LEFT JOIN docs d ON a.doc_id = d.doc_id GROUP BY a.source""",
    "token_budget": f"WITH {_DOCS}, {_BUDGET} SELECT * FROM kept",
    "pack_flush_after": f"WITH RECURSIVE {_DOCS}, {_packed('after', 'docs', ['source'], 'doc_id')} SELECT source, doc_id, n_tokens, shard_index FROM packed",
    "pack_flush_before": f"WITH RECURSIVE {_DOCS}, {_packed('before', 'docs', ['source'], 'doc_id')} SELECT source, doc_id, n_tokens, shard_index FROM packed",
    "tokenize_report": f"""WITH RECURSIVE {_DOCS}, {_packed('after', 'docs', ['source'], 'doc_id')}
      SELECT source, count(*) AS documents, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, max(shard_index) + 1 AS shards FROM packed GROUP BY source""",
    "stream_packing": f"""WITH RECURSIVE {_DOCS}, {_packed('after', 'docs', ['source'], 'doc_id')} SELECT source, doc_id, n_tokens, rn - 1 AS doc_index, shard_index FROM packed""",
    "shard_scan": f"WITH {_SCAN} SELECT * FROM noted",
    "source_check": f"WITH {_SCAN}, {_GAPS} SELECT s.source, s.shards, s.tokens, s.eos_tokens, coalesce(l.missing, '') AS missing FROM span s LEFT JOIN listed l USING (source)",
    "check_messages": f"""WITH {_SCAN}, {_GAPS} SELECT 'error' AS level, 0 AS place, path AS subject, path || ': ' || error AS message FROM noted WHERE error IS NOT NULL
      UNION ALL SELECT 'warning', 0, path, path || ': ' || warning FROM noted WHERE warning IS NOT NULL
      UNION ALL SELECT 'error', 1, source, source || ': missing shard indices ' || replace(missing, ',', ', ') FROM listed""",
    "check_totals": f"WITH {_SCAN} SELECT count(*) AS files, sum(tokens)::BIGINT AS total_tokens, sum(eos_tokens)::BIGINT AS total_eos_tokens FROM noted",
    "shard_name_parse": r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'root/' || source || '_1_' || lpad(doc_id::VARCHAR, 5, '0') || '.bin' WHEN 1 THEN 'root/train/' || source || '/part.bin'
        WHEN 2 THEN 'root/loose.bin' ELSE 'root/val/' || source || '_' || doc_id || '.bin' END AS path FROM documents),
      q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/?[^/]*$', '') AS parent FROM p)
      SELECT doc_id, path, CASE WHEN regexp_matches(name, '^(.+)_(\d+)\.bin$') THEN regexp_extract(name, '^(.+)_(\d+)\.bin$', 1) WHEN parent = 'root' THEN '<root>' ELSE regexp_replace(parent, '^root/', '') END AS check_source,
        CASE WHEN regexp_matches(name, '^(.+)_(\d+)\.bin$') THEN regexp_extract(name, '^(.+)_(\d+)\.bin$', 2)::BIGINT END AS shard_index,
        CASE WHEN regexp_matches(name, '^(.+)_(\d+)\.bin$') THEN regexp_extract(name, '^(.+)_(\d+)\.bin$', 1) ELSE regexp_extract(parent, '[^/]*$') END AS split_source FROM q""",
    "missing_shards": f"WITH {_SCAN}, {_GAPS} SELECT source, shard_index FROM gaps",
    "first_documents": f"""WITH {_TOKENS}, ends AS (SELECT source, shard_index, coalesce(min(position) FILTER (token = 46 AND position < 2000000), 256) AS e FROM tokens GROUP BY ALL)
      SELECT e.source, e.shard_index, count(t.token) AS n_tokens, coalesce(sum(t.token), 0)::BIGINT AS id_sum FROM ends e LEFT JOIN tokens t ON t.source = e.source AND t.shard_index = e.shard_index AND t.position < e.e GROUP BY ALL""",
    "document_index": f"WITH {_INDEXED} SELECT doc_id, source, n_tokens, doc_index FROM numbered",
    "doc_segments": f"""WITH {_TOKENS}, marked AS (SELECT source, token, coalesce(sum(CASE WHEN token = 46 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY shard_index, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS doc_index FROM tokens)
      SELECT source, doc_index, count(*) AS n_tokens, bool_or(token = 46) AS complete FROM marked GROUP BY ALL""",
    "split_assignment_md5": f"WITH {_SPLIT} SELECT doc_id, source, n_tokens, doc_index, split FROM parted",
    "split_shards": f"WITH RECURSIVE {_SPLIT}, {_packed('before', 'parted', ['split', 'source'], 'doc_index')} SELECT split, source, doc_index, n_tokens, shard_index FROM packed",
    "split_report": f"""WITH {_SPLIT} SELECT source, count(*) AS documents, count(*) FILTER (split = 'train') AS train_documents, coalesce(sum(n_tokens) FILTER (split = 'train'), 0)::BIGINT AS train_tokens,
      count(*) FILTER (split = 'val') AS val_documents, coalesce(sum(n_tokens) FILTER (split = 'val'), 0)::BIGINT AS val_tokens FROM parted GROUP BY source""",
    "split_summary": f"""WITH {_SPLIT} SELECT coalesce(sum(n_tokens) FILTER (split = 'train'), 0)::BIGINT AS train_tokens, coalesce(sum(n_tokens) FILTER (split = 'val'), 0)::BIGINT AS val_tokens,
      coalesce(sum(n_tokens) FILTER (split = 'val'), 0)::DOUBLE / sum(n_tokens)::DOUBLE AS val_share FROM parted""",
    "window_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "window_boundaries": f"WITH {_COUNTS}, {_BOUNDS} SELECT * FROM bounds",
    "token_windows": f"WITH {_TILES} SELECT source, shard_index, window_index, x_first, x_sum, y_last, y_sum FROM tiles",
    "full_split_samples": f"""WITH {_TILES}, sizes AS (SELECT source, shard_index, count(*) AS tokens FROM tokens GROUP BY ALL), counts AS (SELECT source, shard_index, tokens // 65 AS windows,
        coalesce(sum(tokens // 65) OVER (PARTITION BY source ORDER BY shard_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_window FROM sizes), {_BOUNDS},
      placed AS (SELECT (b.first_sample + c.first_window + t.window_index)::BIGINT AS sample_index, t.source, b.source_id, t.shard_index, t.window_index, t.token_sum FROM tiles t JOIN counts c USING (source, shard_index) JOIN bounds b ON b.source = t.source)
      SELECT sample_index, sample_index // 5 AS batch_id, source, source_id, shard_index, window_index, token_sum FROM placed""",
    "source_quotas": f"WITH {_quota('(1), (2), (7), (8), (30), (32), (100)')} SELECT batch_size::INT AS batch_size, source, (low + CASE WHEN k <= spare THEN 1 ELSE 0 END)::INT AS quota FROM ordered",
    "unit_labels": f"""WITH {_WEIGHTS}, b(batch_size) AS (VALUES (1), (8), (32)), s AS (SELECT b.batch_size AS batch, {_UNIT} AS batch_size FROM b),
      base AS (SELECT batch, batch_size, source, CAST(weight AS DOUBLE) * batch_size AS raw, floor(CAST(weight AS DOUBLE) * batch_size) AS low FROM s, w),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY low - raw, source) AS k, batch_size - sum(low) OVER (PARTITION BY batch) AS spare FROM base)
      SELECT batch::INT AS batch_size, source, (low + CASE WHEN k <= spare THEN 1 ELSE 0 END)::INT AS labels, batch_size::INT AS unit_size FROM ordered""",
    "resume_position": f"""WITH {_COUNTS}, totals AS (SELECT source, sum(windows)::BIGINT AS windows FROM counts GROUP BY source), w(source, weight) AS (VALUES ('assistant', 0.5), ('system', 0.125), ('user', 0.375)),
      b(batch_size) AS (VALUES (8)), z AS (SELECT {_UNIT} AS unit_size FROM b),
      u AS (SELECT source, unit_size, (weight * unit_size)::BIGINT AS per_unit FROM w, z),
      s AS (SELECT source, (1500 * 8 // unit_size * per_unit)::BIGINT AS served, windows FROM u JOIN totals USING (source)) SELECT source, served, served // windows AS pass, served % windows AS cursor FROM s""",
    "hashed_pass_order": f"""WITH {_COUNTS}, totals AS (SELECT source, sum(windows)::BIGINT AS windows FROM counts GROUP BY source), each AS (SELECT source, i AS window_index FROM totals, unnest(range(0, windows)) AS u(i))
      SELECT source, 0 AS pass, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || source || '|0|' || window_index)) - 1 AS rank, window_index FROM each""",
    "missing_sources": "SELECT source FROM (VALUES ('assistant'), ('critic'), ('tool')) AS w(source) WHERE source NOT IN (SELECT role FROM conversations)",
    "conversation_status": f"WITH {_judged('assistant')} SELECT conv_id, turns, error FROM judged",
    "sft_examples": f"WITH {_EXAMPLES} SELECT conv_id, status, n_tokens, assistant_tokens, id_sum FROM examples",
    "sft_offsets": f'WITH {_OFFSETS} SELECT conv_id, example_index, start, start + n_tokens AS "end" FROM kept',
    "sft_audit": f"""WITH {_EXAMPLES} SELECT count(*) AS scanned, count(*) FILTER (status = 'retained') AS retained, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'invalid') AS invalid,
      coalesce(sum(n_tokens) FILTER (status = 'retained'), 0)::BIGINT AS total_tokens, coalesce(sum(assistant_tokens) FILTER (status = 'retained'), 0)::BIGINT AS total_assistant_tokens,
      avg(n_tokens) FILTER (status = 'retained') AS mean_tokens, max(n_tokens) FILTER (status = 'retained') AS max_tokens, avg(assistant_tokens) FILTER (status = 'retained') AS mean_assistant_tokens,
      max(assistant_tokens) FILTER (status = 'retained') AS max_assistant_tokens FROM examples""",
    "generation_prompts": f"WITH {_judged('user')}, {_MADE} SELECT conv_id, n_tokens + 11 AS n_tokens, (id_sum + list_sum(list_transform(range(1, 12), lambda k: unicode(substr('assistant: ', k::INT, 1)))))::BIGINT AS id_sum FROM made",
    "collated_batches": f"""WITH {_OFFSETS}, wide AS (SELECT *, example_index // 4 AS batch_id, max(n_tokens) OVER (PARTITION BY example_index // 4) AS width FROM kept)
      SELECT conv_id, batch_id, width, (id_sum + 2 * (width - n_tokens))::BIGINT AS id_sum, assistant_tokens AS mask_sum FROM wide""",
    "masked_loss": f"""WITH {_EXAMPLES}, answers AS (SELECT s.conv_id, list_sum(list_transform(range(1, length(s.text) + 1), lambda k: unicode(substr(s.text, k::INT, 1)) % 256)) + 12 AS t, length(s.text) + 2 AS n
        FROM steps s JOIN examples e USING (conv_id) WHERE e.status = 'retained' AND s.r = 'assistant')
      SELECT conv_id, round(sum(t)::DOUBLE / 64.0 / sum(n)::DOUBLE, 9) AS mean_loss, sum(n)::BIGINT AS targets FROM answers GROUP BY conv_id""",
    "sft_eval": f"""WITH {_LOSSES} SELECT {_summary('sum(loss)', 'sum(correct::BIGINT)', 'count(*)')} FROM losses""",
    "token_metrics": f"WITH {_LOSSES} SELECT {_summary('sum(loss)', 'sum(correct::BIGINT)', 'count(*)')} FROM losses",
    "source_metrics": f"""WITH {_LOSSES}, names AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'unseen') SELECT n.source, upper(n.source) AS name, {_summary('sum(l.loss)', 'sum(l.correct::BIGINT)', 'count(l.doc_id)')}
      FROM names n LEFT JOIN losses l ON l.source = n.source GROUP BY n.source""",
    "logged_means": f"""WITH {_LOSSES}, s AS (SELECT CAST(ceil(doc_id / 50.0) * 50 AS BIGINT) AS logged_step, loss, doc_id % 7 + 1 AS tokens FROM losses)
      SELECT logged_step, sum(tokens)::BIGINT AS tokens, round(sum(loss * tokens) / sum(tokens)::DOUBLE, 6) AS mean_loss FROM s GROUP BY logged_step""",
    "best_validation": f"""WITH {_LOSSES}, e AS (SELECT doc_id // 50 AS step, round(avg(loss), 6) AS loss FROM losses GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e)
      SELECT step, loss, best_before, best_before IS NULL OR loss < best_before AS improved FROM b""",
    "finite_check": "SELECT vec_id, len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) = 0 AS finite FROM embeddings",
    "decay_groups": f"WITH {_PARAMS} SELECT p_partkey, dimensions >= 2 AND NOT (name LIKE '%.bias' OR contains(name, 'embedding') OR contains(name, 'lm_head')) AS decays FROM params",
    "parameter_count": f"WITH {_PARAMS} SELECT sum(elements)::BIGINT AS parameters, coalesce(sum(elements) FILTER (trainable), 0)::BIGINT AS trainable_parameters FROM params",
    "topk_filter": f"WITH {_LOGITS} SELECT vec_id, token, logit FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM logits) WHERE r <= 5",
    "topp_filter": f"""WITH {_SOFT}, e AS (SELECT l.vec_id, l.token, l.logit, exp(l.logit - t.top) AS x FROM logits l JOIN tops t USING (vec_id)), p AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS pr FROM e),
      c AS (SELECT *, coalesce(sum(pr) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, token FROM c WHERE before <= 0.4""",
    "greedy_argmax": f"WITH {_LOGITS} SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r FROM logits) WHERE r = 1",
    "token_probabilities": f"WITH {_SOFT}, e AS (SELECT l.vec_id, l.token, exp((l.logit - t.top) / 0.7) AS x FROM logits l JOIN tops t USING (vec_id)) SELECT vec_id, token, round(x / sum(x) OVER (PARTITION BY vec_id), 9) AS prob FROM e",
    "loglikelihood": f"""WITH {_SOFT}, z AS (SELECT l.vec_id, ln(sum(exp(l.logit - t.top))) + any_value(t.top) AS z, arg_max(l.token, l.logit) AS best FROM logits l JOIN tops t USING (vec_id) GROUP BY l.vec_id)
      SELECT l.vec_id // 10 AS request, round(sum(l.logit - z.z), 6) AS log_likelihood, bool_and(l.token = z.best) AS is_greedy FROM logits l JOIN z USING (vec_id) WHERE l.token = l.vec_id % 64 GROUP BY 1""",
    "rolling_windows": f"""WITH {_REQUESTS}, r AS (SELECT item_id, ids, s AS target_start, least(s + 49, len(ids)) AS target_end FROM requests, unnest(range(1, len(ids), 49)) AS u(s))
      SELECT item_id, target_start::BIGINT AS target_start, target_end::BIGINT AS target_end, (target_end - target_start + 1)::BIGINT AS width, list_sum(ids[target_start:target_end])::BIGINT AS id_sum FROM r""",
    "left_truncate": f"""WITH {_REQUESTS}, c AS (SELECT item_id, ids[1:greatest(len(ids) - 20, 0)] AS a, ids[greatest(len(ids) - 20, 0) + 1:] AS b FROM requests), d AS (SELECT item_id, a, least(48 - len(b), len(a)) AS n FROM c)
      SELECT item_id, n::BIGINT AS n_context, coalesce(list_sum(a[len(a) - n + 1:len(a)]), 0)::BIGINT AS id_sum FROM d""",
    "stop_strings": r"""SELECT doc_id, length(split_part(split_part(split_part(text, chr(10), 1), '. ', 1), ',', 1)) AS n_chars FROM documents""",
    "rmsnorm": "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding) + 1e-6) AS s FROM embeddings) SELECT vec_id, (i - 1)::INT AS i, round(embedding[i]::DOUBLE / s, 6) AS x FROM n, unnest(range(1, len(embedding) + 1)) AS u(i)",
    "rotary": """WITH e AS (SELECT vec_id, (i - 1)::INT AS i, embedding, len(embedding) AS n FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)), a AS (SELECT *, vec_id::DOUBLE * pow(10000.0, -(i - i % 2)::DOUBLE / n) AS t FROM e)
      SELECT vec_id, i, round(embedding[i + 1]::DOUBLE * cos(t) + CASE WHEN i % 2 = 0 THEN -1.0 * embedding[i + 2]::DOUBLE ELSE embedding[i]::DOUBLE END * sin(t), 5) AS x FROM a""",
    "silu_gate": f"WITH {_LOGITS} SELECT vec_id, token, round(logit / (1.0 + exp(-logit)), 9) AS gate FROM logits",
    "lr_pretrain": "SELECT doc_id AS step, round(CASE WHEN doc_id < 100 THEN 3e-4 * (doc_id + 1) / 100.0 ELSE 3e-5 + (3e-4 - 3e-5) * 0.5 * (1.0 + cos(greatest(least((doc_id - 100)::DOUBLE / 700.0, 1.0), 0.0) * pi())) END, 12) AS lr FROM documents",
    "lr_sft": "SELECT doc_id AS step, round(CASE WHEN doc_id < 500 THEN 3e-5 * (doc_id + 1) / 500.0 ELSE 3e-5 END, 14) AS lr FROM documents",
}
