"""A store lifted from the driver's tables: one SQL text per table, read by Spark here and by DuckDB in the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame

NOW = 1_700_000_000

#: name -> SQL over {tables}; mk_list stands for the engine's list constructor.
LIFTS = {
    "atoms": f"""SELECT 'A' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'invariant' WHEN 1 THEN 'decision' WHEN 2 THEN 'glossary' WHEN 3 THEN 'owner' ELSE 'convention' END AS type,
  CASE WHEN p_size % 5 = 2 AND p_partkey % 3 = 0 THEN 'module:d' || (p_partkey % 20) WHEN p_size % 5 = 2 AND p_partkey % 5 = 0 THEN 'symbol:d' || (p_partkey % 20) || '/tests/f' || (p_partkey % 40) || '.py:' || p_type
       WHEN p_size % 5 = 2 THEN 'symbol:d' || (p_partkey % 20) || '/f' || (p_partkey % 40) || '.py:' || p_type ELSE 'topic:' || (p_partkey % 500) END AS topic_key,
  CASE WHEN p_size % 5 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'OPEN' ELSE 'CLOSED' END END AS decision_status, CASE WHEN p_size % 5 = 1 AND p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 3 = 1 THEN 'constraint' ELSE 'change' END END AS decision_class,
  CASE WHEN p_size % 5 = 2 AND p_partkey % 3 = 0 THEN 'module' ELSE 'symbol' END AS tier, CASE p_partkey % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'manifest' WHEN 2 THEN 'manual' ELSE 'readme' END AS source_kind,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'd' || (p_partkey % 20) || '/f' || (p_partkey % 40) || '.py:' || p_size ELSE 'd' || (p_partkey % 20) END AS source_ref, CAST(NULL AS VARCHAR(1)) AS source_lines,
  CAST({NOW} - p_partkey * 997 AS BIGINT) AS valid_from, CAST(CASE WHEN p_partkey % 7 = 0 THEN {NOW} - p_partkey * 997 + 500 END AS BIGINT) AS valid_to, CAST({NOW} - p_partkey * 997 AS BIGINT) AS asserted_at,
  CAST(NULL AS VARCHAR(1)) AS superseded_by, CASE p_partkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'none' END AS liveness_kind, CASE WHEN p_partkey % 3 = 0 THEN 'd' || (p_partkey % 20) || '/f' || (p_partkey % 40) || '.py' END AS liveness_target,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 6 = 0 THEN 'def ' || p_brand ELSE '(' END END AS liveness_pattern, CAST(CASE WHEN p_partkey % 12 = 0 THEN {NOW} - p_partkey * 50 END AS BIGINT) AS liveness_last_ok,
  CAST((p_size % 10 + 1) / 10.0 AS DOUBLE) AS confidence, 'r' || (p_partkey % 3) AS repo_id, 'default' AS workspace_id, p_partkey % 11 = 0 AS pinned, p_partkey % 13 = 0 AS archived,
  CAST(CASE WHEN p_partkey % 4 = 2 THEN {NOW} - p_partkey * 997 + 7776000 END AS BIGINT) AS confirm_by, CAST({NOW} - p_partkey * 997 AS BIGINT) AS created_at, CAST({NOW} - p_partkey * 997 AS BIGINT) AS updated_at FROM {{part}}""",
    "summaries": """SELECT 'A' || p_partkey AS atom_id, CAST(r AS INT) AS resolution, CASE WHEN p_partkey % 50 = 0 THEN 'ask joe@corp.org about ' ELSE '' END || p_name || ' ' || p_type || CASE WHEN r = 50 THEN ' see d' || (p_partkey % 20) || '/f' || (p_partkey % 40) || '.py' ELSE '' END AS text,
  CAST(9 AS INT) AS token_count FROM {part} CROSS JOIN (SELECT 10 AS r UNION ALL SELECT 50) x WHERE p_partkey % 6 <> 0 OR r = 10""",
    "edges": f"""SELECT 'E' || p_partkey AS id, 'A' || p_partkey AS src_id, 'A' || ((p_partkey * 7) % 180 + 1) AS dst_id, CASE p_partkey % 6 WHEN 0 THEN 'REFERENCES' WHEN 1 THEN 'ROLLS_UP' WHEN 2 THEN 'OWNS' WHEN 3 THEN 'BLOCKS' WHEN 4 THEN 'CONTRADICTS' ELSE 'MIRRORS' END AS kind,
  p_partkey % 6 < 4 AS directed, CAST((p_partkey % 10 + 1) / 10.0 AS DOUBLE) AS weight, CAST(1.0 AS DOUBLE) AS confidence, CAST({NOW} - p_partkey AS BIGINT) AS valid_from, CAST(CASE WHEN p_partkey % 19 = 0 THEN {NOW} END AS BIGINT) AS valid_to, 'manual' AS source,
  CASE WHEN p_partkey % 23 = 0 THEN 'rejected' WHEN p_partkey % 29 = 0 THEN 'suggested' ELSE 'live' END AS status, CAST({NOW} - p_partkey AS BIGINT) AS created_at FROM {{part}} WHERE p_partkey <> (p_partkey * 7) % 180 + 1""",
    "evidence": f"SELECT 'E' || p_partkey AS edge_id, 'file_path' AS kind, p_name AS payload, CAST({NOW} AS BIGINT) AS created_at FROM {{part}} WHERE p_partkey % 2 = 0",
    "log": f"""SELECT event_id AS id, CAST({NOW} - event_id * 60 AS BIGINT) AS ts, CASE WHEN event_id % 40 = 0 THEN ' x' ELSE event_type || ' of ' || user_id END AS query, CASE WHEN event_id % 5 < 2 THEN mk_list('A' || user_id, 'A' || (user_id + event_id % 7)) END AS atoms_returned,
  CAST(CASE WHEN event_id % 9 <> 0 THEN value / 200.0 END AS DOUBLE) AS top_relevance, CAST(event_id % 3 AS INT) AS n_suppressed, CAST(CASE WHEN event_id % 9 <> 0 THEN 0.25 + (event_id % 2) / 100.0 END AS DOUBLE) AS min_relevance FROM {{events}}""",
    "candidates": f"""SELECT substr(md5(text || conv_id || turn), 1, 16) AS fingerprint, text, 'convention' AS proposed_type, CAST(turn % 7 AS INT) AS score, CAST({NOW} - conv_id AS BIGINT) AS created_at, CASE turn % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'accepted' END AS status,
  CAST(NULL AS BIGINT) AS reviewed_at, CAST(NULL AS VARCHAR(1)) AS atom_id, CAST(NULL AS VARCHAR(1)) AS source_ref FROM {{conversations}} WHERE role = 'user'""",
    "repos": f"""SELECT 'r' || n_nationkey AS repo_id, '/w/' || n_name AS root_path, CASE WHEN n_nationkey % 4 <> 0 THEN substr(md5(n_name), 1, 12) END AS last_indexed_sha, CAST(CASE WHEN n_nationkey % 5 <> 0 THEN {NOW} - n_nationkey END AS BIGINT) AS last_indexed_at, CAST(n_nationkey % 3 AS INT) AS last_atoms_skipped FROM {{nation}}""",
    "probes": """SELECT 'r' || n_nationkey AS repo_id, n_nationkey % 6 <> 5 AS root_exists, n_nationkey % 7 <> 6 AS is_git, CASE WHEN n_nationkey % 8 <> 7 THEN substr(md5(n_name), 3, 12) END AS head_sha, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN 0 END AS BIGINT) AS commits_behind FROM {nation}""",
    "dirty": "SELECT 'r' || s_nationkey AS repo_id, CASE s_suppkey % 4 WHEN 0 THEN '.factloom/x' WHEN 1 THEN '.factloom' ELSE 'src/' || s_name END AS path FROM {supplier}",
    "vectors": "SELECT 'A' || (vec_id + 1) AS atom_id, CASE WHEN vec_id % 10 = 9 THEN 'other' ELSE 'm' END AS model, embedding AS vector FROM {embeddings}",
}


def lifted(t, name: str) -> DataFrame:
    """A table of the lifted store."""
    text = LIFTS[name].replace("mk_list(", "array(").replace("VARCHAR(1)", "STRING")
    tables = {n: getattr(t, n) for n in ("part", "events", "conversations", "nation", "supplier", "embeddings") if "{" + n + "}" in text}
    return t._spark.sql(text, **tables)


def twin(*names: str) -> str:
    """The same tables as common table expressions of DuckDB, opened by WITH."""
    parts = []
    for name in names:
        text = LIFTS[name].replace("mk_list(", "list_value(").replace("VARCHAR(1)", "VARCHAR")
        for table in ("part", "events", "conversations", "nation", "supplier", "embeddings"):
            text = text.replace("{" + table + "}", table)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts) + " "
