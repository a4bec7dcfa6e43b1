"""SQL with the same results as the registered queries, over the same tables."""

from __future__ import annotations

from turnmill.workload.inputs import FAULTS, LONE_USER
from turnmill.workload.queries import LIMIT, RECORDS, SEED, TEST_SIZE, TOKENS_PER_STEP

_BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
)


def _is_blank(text: str) -> str:
    return f"regexp_full_match({text}, '{_BLANK}')"


def _role(position: str) -> str:
    return (
        f"CASE WHEN {position} % 2 = 1 AND doc_id % {LONE_USER} <> {LONE_USER - 1} "
        "THEN 'assistant' ELSE 'user' END"
    )


_PARTS = """parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents)"""


def _said(role: str) -> str:
    return f"""{_PARTS}, said AS (
  SELECT doc_id, i, p AS text, {role} AS role FROM parts WHERE NOT {_is_blank('p')})"""


_SAID = _said(_role("i"))
_SAID_ANTHROPIC = _said(f"CASE WHEN i = 0 THEN 'system' ELSE {_role('(i + 1)')} END")


def _usable(min_messages: int, where: str = "TRUE", name: str = "usable") -> str:
    return f"""{name} AS (
  SELECT doc_id, count(*) AS n_messages FROM said WHERE {where} GROUP BY doc_id
  HAVING count(*) >= {min_messages} AND bool_or(role = 'assistant'))"""


_TURNS = "row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS turn, role, text"
_LONG = f"SELECT doc_id + 1 AS lineno, {_TURNS} FROM said JOIN usable USING (doc_id)"

_KIND = f"doc_id % {FAULTS}"
_ERROR = f"""CASE {_KIND} WHEN 0 THEN 'invalid_json' WHEN 7 THEN 'not_object'
  WHEN 14 THEN 'missing_messages' WHEN 21 THEN 'messages_not_list'
  WHEN 28 THEN 'message_not_object' END"""
_DETAIL = f"""CASE {_KIND} WHEN 14 THEN '["id","turns"]' WHEN 28 THEN '7' END"""

# Rollouts: user turns and the assistant turns after them.
_DATUMS = """pairs AS (
  SELECT a.conv_id * 1000 + a.turn AS seq_id,
         [length(w) FOR w IN string_split(u.text, ' ')] AS prompt,
         [length(w) FOR w IN string_split(a.text, ' ')] AS sampled,
         CASE WHEN (a.conv_id + a.turn) % 2 = 0 THEN 1.0 ELSE -1.0 END AS adv
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
datums AS (
  SELECT seq_id, len(prompt) - 1 AS observed, len(sampled) AS n, adv, sampled,
         list_concat(prompt, sampled[1:len(sampled) - 1]) AS model_input
  FROM pairs)"""
_POSITIONS = """
SELECT seq_id, pos, model_input[pos + 1] AS model_input,
       CASE WHEN pos < observed THEN 0 ELSE sampled[pos - observed + 1] END AS target_tokens,
       CASE WHEN pos < observed THEN 0.0 ELSE -(sampled[pos - observed + 1] + 1) / 8.0 END AS logprobs,
       CASE WHEN pos < observed THEN 0.0 ELSE adv END AS advantages
FROM (SELECT *, unnest(range(len(model_input))) AS pos FROM datums)"""

# Ratios: the vector times a factor against the reversed vector.
_TOKENS = """tokens AS (
  SELECT vec_id AS seq_id, vec_id, pos, embedding[pos + 1]::DOUBLE * (1 + vec_id % 20) AS new_lp,
         embedding[len(embedding) - pos]::DOUBLE AS old_lp,
         CASE WHEN pos < vec_id % 8 THEN 0.0 WHEN vec_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS adv
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""
_RATED = f"""{_TOKENS}, rated AS (
  SELECT seq_id, avg(new_lp - old_lp) FILTER (adv <> 0) AS log_ratio,
         exp(avg(new_lp - old_lp) FILTER (adv <> 0)) AS ratio
  FROM tokens GROUP BY seq_id),
gated AS (
  SELECT *, ratio BETWEEN 0.8 AND 1.2 AS inside,
         CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN ratio ELSE 0.0 END AS weight FROM rated)"""


def _ranked(keys: str, source: str, seed: int = SEED) -> str:
    """Rows of ``source`` with their rank in hashed order."""
    text = " || '|' || ".join(f"{k}::VARCHAR" for k in keys.split(", "))
    return f"""ranked AS (
  SELECT {keys}, row_number() OVER (ORDER BY md5('{seed}|' || {text}), {keys}) - 1 AS rank
  FROM {source})"""


_KEYS = f"{_SAID}, {_usable(2)}, keys AS (SELECT doc_id + 1 AS lineno FROM usable)"

# A digest of all messages of a conversation.
_DIGESTS = """digests AS (
  SELECT doc_id + 1 AS lineno, md5(string_agg(role || ':' || text, chr(10) ORDER BY i)) AS digest FROM said GROUP BY doc_id)"""

_TIMED = """first AS (SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type),
timed AS (SELECT e.event_type AS path, e.event_id AS step, e.value AS seconds
  FROM events e JOIN first f ON e.event_type = f.event_type AND e.event_id <> f.event_id)"""
_SUMMARY = f"""{_TIMED}, summary AS (
  SELECT path, count(*) AS steps, avg(seconds) AS mean_raw,
         coalesce(stddev_samp(seconds), 0.0) AS stdev_raw,
         {TOKENS_PER_STEP} / avg(seconds) AS tokens_per_s_raw
  FROM timed GROUP BY path)"""

_OUTCOMES = """logs AS (
  SELECT l_orderkey AS task, l_suppkey % 4 AS "group", l_quantity::INT AS q, l_linenumber AS n
  FROM lineitem),
coded AS (
  SELECT *, CASE WHEN q % 11 = 0 THEN 124 WHEN q % 13 = 0 THEN 126 WHEN q % 3 = 0 THEN 1
                 WHEN n % 4 = 3 THEN 2 ELSE 0 END AS exit_code FROM logs),
labelled AS (
  SELECT *, CASE WHEN exit_code = 124 THEN 'timed_out'
                 WHEN exit_code = 126 OR (exit_code = 1 AND q % 2 = 0) THEN 'terminated'
                 WHEN exit_code = 0 THEN 'ok' ELSE 'failed' END AS outcome FROM coded)"""

_METRIC = "json_extract(props, '$.k')::DOUBLE / 128"

ORACLES = {
    "scan_jsonl": "SELECT doc_id, length(text) AS n, TRUE AS exact FROM documents",
    "json_record": f"SELECT doc_id + 1 AS lineno, {_KIND} <> 0 AS is_json FROM documents",
    "normalize_role": """
SELECT conv_id, turn, spelled, CASE lower(spelled) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant'
  WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system'
  WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' END AS normalized
FROM (SELECT conv_id, turn, ['human', 'AI', 'Model', 'tool', 'function', 'narrator', 'SYSTEM', role]
             [(conv_id + turn) % 8 + 1] AS spelled FROM conversations)""",
    "flatten_content": f"""
WITH {_PARTS}
SELECT doc_id, coalesce(string_agg(p, chr(10) ORDER BY i)
  FILTER (i % 4 IN (0, 2) AND NOT {_is_blank('p')}), '') AS flat FROM parts GROUP BY doc_id""",
    "is_blank": f"""
WITH {_PARTS} SELECT doc_id, i, i % 3 <> 0 OR {_is_blank('p')} AS blank FROM parts""",
    "import_messages": f"WITH {_SAID}, {_usable(2)} {_LONG}",
    "import_openai": f"WITH {_SAID}, {_usable(2)} {_LONG}",
    "import_anthropic": f"WITH {_SAID_ANTHROPIC}, {_usable(2)} {_LONG}",
    "import_turns": f"""
WITH said AS (SELECT * FROM conversations WHERE NOT {_is_blank('text')}),
usable AS (SELECT conv_id FROM said GROUP BY conv_id
  HAVING count(*) >= 3 AND bool_or(role = 'assistant'))
SELECT conv_id, turn, role, text FROM said WHERE conv_id IN (SELECT conv_id FROM usable)""",
    "import_errors": f"""
SELECT doc_id + 1 AS lineno, {_ERROR} AS error_class, {_DETAIL} AS detail
FROM documents WHERE {_KIND} % 7 = 0""",
    "first_error": f"""
SELECT doc_id + 1 AS lineno, {_ERROR} AS error_class, {_DETAIL} AS detail
FROM documents WHERE {_KIND} IN (0, 7, 14, 21, 28) ORDER BY doc_id LIMIT 1""",
    "fail_loud": f"""
WITH earliest AS (SELECT doc_id AS d, {_ERROR} AS error_class FROM documents
  WHERE {_KIND} IN (0, 7, 14, 21, 28) ORDER BY doc_id LIMIT 1)
SELECT (SELECT count(*) FROM documents WHERE doc_id <= d) AS lineno, error_class, 0 AS files_before FROM earliest""",
    "import_limit": f"""
WITH {_SAID}, {_usable(2, "doc_id % 7 <> 0")}, {_DIGESTS}
SELECT digest FROM digests WHERE lineno IN (SELECT doc_id + 1 FROM usable ORDER BY doc_id LIMIT {LIMIT})""",
    "import_file_job": f"""
WITH {_SAID}, {_usable(2, "doc_id % 7 <> 0")},
kept AS (SELECT count(*) AS n FROM usable), bad AS (SELECT count(*) AS n FROM documents WHERE {_KIND} IN (0, 7, 14, 21, 28))
SELECT kept.n AS conversations, kept.n AS written, bad.n AS skipped, bad.n AS put_aside FROM kept, bad""",
    "import_stream_restart": f"""
WITH {_SAID}, {_usable(2, "doc_id % 7 <> 0")}
SELECT 'kept' AS part, count(*) AS n FROM usable
UNION ALL SELECT 'put aside', count(*) FROM documents WHERE {_KIND} IN (0, 7, 14, 21, 28)""",
    "import_stream_faults": f"""
SELECT {_ERROR} AS error_class, count(*) AS places FROM documents WHERE {_KIND} IN (0, 7, 14, 21, 28) GROUP BY 1""",
    "import_skip_errors": f"""
WITH {_SAID}, {_usable(2, "doc_id % 7 <> 0")} SELECT doc_id + 1 AS lineno, n_messages FROM usable""",
    "usable_conversations": f"""
WITH {_SAID}, {_usable(4)} SELECT doc_id + 1 AS lineno, n_messages FROM usable""",
    "limit_conversations": f"""
WITH {_SAID}, {_usable(4, name="enough")},
usable AS (SELECT doc_id FROM enough ORDER BY doc_id LIMIT 10) {_LONG}""",
    "import_summary": f"""
WITH {_SAID}, {_usable(2)}, both_formats AS (SELECT count(*) AS conversations FROM usable)
SELECT 'messages' AS format, conversations FROM both_formats
UNION ALL SELECT 'openai', conversations FROM both_formats
UNION ALL SELECT 'anthropic', (WITH {_SAID_ANTHROPIC}, {_usable(2)} SELECT count(*) FROM usable)""",
    "write_messages_jsonl": f"""
WITH {_SAID_ANTHROPIC}, {_usable(2)} SELECT {_TURNS} FROM said JOIN usable USING (doc_id)""",
    "stage_dataset": "SELECT doc_id, text FROM documents",
    "import_stream": f"""
WITH {_SAID}, {_usable(2)} SELECT {_TURNS} FROM said JOIN usable USING (doc_id)""",
    "assemble_datum": f"WITH {_DATUMS} {_POSITIONS}",
    "loss_mask": """
SELECT vec_id AS seq_id, greatest(len(embedding) - vec_id % 8, 1) AS n_trained,
       vec_id % 8 + 1 AS first_trained FROM embeddings""",
    "rollout_batch_stats": f"""
WITH {_DATUMS}
SELECT seq_id % 16 AS batch, count(*) AS sequences, min(n) AS min_length,
       round(avg(n), 6) AS mean_length, max(n) AS max_length,
       sum(len(model_input))::BIGINT AS total_tokens
FROM datums GROUP BY 1""",
    "sequence_log_ratio": f"WITH {_RATED} SELECT seq_id, round(log_ratio, 6) AS log_ratio FROM rated",
    "token_log_ratio": f"WITH {_RATED} SELECT seq_id, round(log_ratio, 6) AS log_ratio FROM rated",
    "sequence_importance_ratio": f"WITH {_RATED} SELECT seq_id, round(ratio, 6) AS ratio FROM rated",
    "clip_gate": f"""
WITH {_RATED}
SELECT seq_id, inside, ratio BETWEEN 0.95 AND 1.05 AS inside_narrow FROM gated""",
    "reweight_advantages": f"""
WITH {_RATED}
SELECT seq_id, pos, round(adv * weight, 6) + 0.0 AS advantage FROM tokens JOIN gated USING (seq_id)""",
    "swap_logprobs": f"""
WITH {_TOKENS}
SELECT seq_id, pos, round(new_lp, 6) AS logprob, adv AS advantage FROM tokens""",
    "second_pass": f"""
WITH {_RATED}, sums AS (
  SELECT seq_id, sum(adv) AS total, max(new_lp) FILTER (pos = 0) AS first_lp
  FROM tokens GROUP BY seq_id)
SELECT seq_id, inside, round(weight, 6) AS weight, round(total * weight, 4) + 0.0 AS total_advantage,
       round(first_lp, 6) AS first_logprob
FROM sums JOIN gated USING (seq_id)""",
    "clip_fraction": f"""
WITH {_RATED}
SELECT seq_id % 16 AS batch, round(avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END), 6) AS clip_fraction
FROM gated GROUP BY 1""",
    "holdout_split": f"""
WITH {_KEYS}, {_DIGESTS}, {_ranked("lineno", "keys")}
SELECT lineno, digest, CASE WHEN rank < {TEST_SIZE} THEN 'test' ELSE 'train' END AS split FROM ranked JOIN digests USING (lineno)""",
    "batch_plan": f"""
WITH {_KEYS}, {_DIGESTS}, {_ranked("lineno", "keys")}
SELECT lineno, digest, rank, rank // 8 AS batch FROM ranked JOIN digests USING (lineno)""",
    "supervised_dataset": f"""
WITH {_KEYS}, {_DIGESTS}, {_ranked("lineno", "keys")}, placed AS (
  SELECT lineno, digest, CASE WHEN rank >= {TEST_SIZE} THEN rank - {TEST_SIZE} END AS rank FROM ranked JOIN digests USING (lineno))
SELECT lineno, digest, rank, rank // 8 AS batch FROM placed""",
    "training_schedule": f"""
WITH {_ranked("doc_id", "documents", 0)},
batches AS (SELECT rank // 8 AS batch, count(*) AS size FROM ranked GROUP BY 1),
steps AS (SELECT epoch * (SELECT count(*) FROM batches) + batch AS step, epoch, batch, size
  FROM batches CROSS JOIN (SELECT unnest(range(3)) AS epoch))
SELECT step, epoch, batch, size, (step + 1) % 20 = 0 AS save, (step + 1) % 7 = 0 AS evaluate
FROM steps""",
    "rollout_plan": f"""
WITH prompts AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
{_ranked("conv_id, turn", "prompts")}
SELECT conv_id, turn, rank // 64 AS step, rank % 64 AS "group", unnest(range(8)) AS member
FROM ranked""",
    "truncate_tokens": f"WITH {_DATUMS} {_POSITIONS} WHERE pos < 16",
    "task_catalog": """
SELECT 'set' || p_partkey % 3 AS dataset, 't' || p_partkey // 3 AS task_name, p_name AS instruction, p_brand AS test_script,
       p_type AS dockerfile, CASE WHEN p_partkey % 5 <> 0 THEN p_size::VARCHAR END AS task_toml
FROM part""",
    "filter_tasks": """
SELECT p_partkey, p_name AS task_name FROM part WHERE contains(p_name, 'ring')""",
    "require_tasks": """
SELECT text, CASE WHEN n > 0 THEN n END AS n FROM (
  SELECT text, (SELECT count(*) FROM part WHERE contains(p_name, text)) AS n
  FROM (VALUES ('ring'), ('e'), ('no part is called so')) t(text))""",
    "limit_tasks_ties": """
SELECT task_name, count(*) AS n FROM (
  SELECT 't' || p_partkey % 10 AS task_name FROM part ORDER BY 1 LIMIT 25) GROUP BY task_name""",
    "limit_tasks": """
SELECT p_partkey, p_name AS task_name FROM part WHERE contains(p_name, 'ring')
ORDER BY p_name, p_partkey LIMIT 25""",
    "limit_tasks_large": """
SELECT p_partkey, p_name AS task_name FROM part ORDER BY p_name, p_partkey LIMIT 1500""",
    "truncate_output": """
SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE
  left(text, k) || CASE WHEN strlen(left(text, k)) < 100 THEN chr(65533) ELSE '' END
  || chr(10) || '[truncated: ' || (strlen(text) - 100) || ' bytes dropped]' END AS stdout
FROM (SELECT *, list_max([j FOR j IN range(101) IF strlen(left(text, j)) <= 100]) AS k
      FROM documents)""",
    "command_outcome": f"""
WITH {_OUTCOMES} SELECT exit_code, outcome, count(*) AS n FROM labelled GROUP BY ALL""",
    "verdict_reward": f"""
WITH {_OUTCOMES}
SELECT task, "group", count(*) AS rollouts,
       round(avg(CASE WHEN outcome = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate,
       count(*) FILTER (outcome = 'ok') AS n_ok, count(*) FILTER (outcome = 'failed') AS n_failed,
       count(*) FILTER (outcome = 'timed_out') AS n_timed_out,
       count(*) FILTER (outcome = 'terminated') AS n_terminated
FROM labelled GROUP BY 1, 2""",
    "step_timing_summary": f"""
WITH {_SUMMARY}
SELECT path, steps, round(mean_raw, 6) AS mean_raw, round(stdev_raw, 6) AS stdev_raw,
       round(tokens_per_s_raw, 6) AS tokens_per_s_raw, round(mean_raw, 3) AS mean_s,
       round(stdev_raw, 3) AS stdev_s, round(tokens_per_s_raw, 1) AS tokens_per_s
FROM summary""",
    "step_times": f"WITH {_TIMED} SELECT path, step, round(seconds, 3) AS seconds FROM timed",
    "path_comparison": f"""
WITH {_SUMMARY}, a AS (SELECT * FROM summary WHERE path = 'view'),
b AS (SELECT * FROM summary WHERE path = 'click')
SELECT round(100 * (1 - round(a.mean_raw, 3) / round(b.mean_raw, 3)), 1) + 0.0 AS step_time_reduction_pct,
       round(100 * (round(a.tokens_per_s_raw, 1) / round(b.tokens_per_s_raw, 1) - 1), 1) + 0.0
         AS throughput_gain_pct
FROM a, b""",
    "bench_tidy": f"""
WITH runs AS (SELECT user_id % {RECORDS} AS record_id,
  CASE event_type WHEN 'view' THEN 'native_1pass' ELSE 'custom_2pass' END AS path,
  event_id, value FROM events),
ordered AS (SELECT *, row_number() OVER (PARTITION BY record_id, path ORDER BY event_id) AS nth FROM runs),
sides AS (SELECT record_id, path, round(avg(value), 6) AS mean_s,
  round({TOKENS_PER_STEP} / avg(value), 6) AS rate
  FROM ordered WHERE nth > 1 GROUP BY record_id, path),
both_paths AS (SELECT r.record_id, p.path, p.position, s.mean_s, s.rate
  FROM (SELECT DISTINCT record_id FROM sides) r
  CROSS JOIN (VALUES ('custom_2pass', 0), ('native_1pass', 1)) p(path, position)
  LEFT JOIN sides s ON s.record_id = r.record_id AND s.path = p.path)
SELECT record_id, 'step time (s)' AS metric, 'lower' AS better, position, path, mean_s AS value
FROM both_paths
UNION ALL SELECT record_id, 'tokens / s', 'higher', position, path, rate FROM both_paths""",
    "scan_metrics_jsonl": """
SELECT event_type AS run_id, event_id AS step, CASE WHEN event_id % 5 >= 2 THEN 0.1::DOUBLE END AS lr
FROM events""",
    "metric_curve": f"""
SELECT event_type AS run_id, event_id AS step, 100 * {_METRIC} AS value
FROM events WHERE event_id % 5 < 2""",
    "metric_curve_stream": f"""
SELECT event_type AS run_id, event_id AS step, 100 * {_METRIC} AS value
FROM events WHERE event_id % 5 < 2""",
    "metric_curve_growing": f"""
SELECT event_type AS run_id, event_id AS step, 100 * {_METRIC} AS value
FROM events WHERE event_id % 5 < 2""",
}
