"""Tables of the fact store: explicit schemas and closed enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_KINDS |= {f"array<{k}>": T.ArrayType(v) for k, v in {**_KINDS, "float": T.FloatType()}.items()}


def _schema(columns: str) -> T.StructType:
    """``name type, ...`` without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


# fixed values
ATOM_TYPES = ("invariant", "schema_fact", "decision", "convention", "dependency", "owner", "runtime", "build_recipe", "glossary")
DECISION_STATUSES = ("OPEN", "CLOSED", "DEFERRED")
DECISION_CLASSES = ("constraint", "change")
SOURCE_KINDS = ("commit", "transcript", "schema_snapshot", "sentry_event", "screenshot", "readme", "manifest", "llm_extract", "manual")
LIVENESS_KINDS = ("regex", "ast", "sql", "none")
TIERS = ("module", "file", "symbol")
EDGE_SOURCES = ("shared_ref", "embed_sim", "commit_couple", "llm_extract", "git_blame", "manual", "schema_diff")
NATURAL_SOURCES = ("commit", "schema_snapshot", "manifest")
RESOLUTIONS = (10, 50, 250)
SYMMETRIC_KINDS = ("CONTRADICTS", "CO_CHANGED", "MIRRORS")
REVERSE_WALKED = ("BLOCKS",)
KIND_WEIGHTS = {
    "MIRRORS": 1.0, "IMPLEMENTS": 0.9, "BLOCKS": 0.9, "CONTRADICTS": 0.8, "SUPERSEDES": 0.7, "DERIVED_FROM": 0.6,
    "ROLLS_UP": 0.6, "LOCATED_IN": 0.6, "REFERENCES": 0.5, "DEPENDS_ON": 0.5, "OWNS": 0.4, "CO_CHANGED": 0.4,
}
UNKNOWN_KIND_WEIGHT = 0.3
EDGE_STATUS_RANK = {"rejected": 3, "live": 2, "suggested": 1}
LIVENESS_RANK = {"ast": 3, "regex": 2, "sql": 1, "none": 0}
ROUTES = {"navigational": (3, 10), "semantic": (5, 50), "contradictory": (7, 50), "implementation": (5, 50)}
TURN_TOKENS = 3000
HOOK_EVENTS = ("session-start", "prompt", "post-tool", "stop", "pre-compact")
EPISODIC_EVENTS = ("pre-compact",)

ATOMS = _schema(
    "id string, type string, topic_key string, decision_status string, decision_class string, tier string, source_kind string, "
    "source_ref string, source_lines string, valid_from long, valid_to long, asserted_at long, superseded_by string, liveness_kind string, "
    "liveness_target string, liveness_pattern string, liveness_last_ok long, confidence double, repo_id string, workspace_id string, "
    "valid_in_refs array<string>, pinned boolean, archived boolean, confirm_by long, created_at long, updated_at long"
)
SUMMARIES = _schema("atom_id string, resolution int, text string, token_count int")
EDGES = _schema("id string, src_id string, dst_id string, kind string, directed boolean, weight double, confidence double, valid_from long, valid_to long, source string, status string, created_at long")
EVIDENCE = _schema("edge_id string, kind string, payload string, created_at long")
VECTORS = _schema("atom_id string, model string, resolution int, hash string, vector array<float>, embedded_at long")
RETRIEVAL_LOG = _schema("id long, ts long, session_id string, query string, classified_as string, atoms_returned array<string>, injected_tokens int, user_feedback string, relevances array<double>, top_relevance double, n_suppressed int, min_relevance double")
CANDIDATES = _schema("fingerprint string, text string, proposed_type string, score int, signals array<string>, source string, source_ref string, session_id string, created_at long, status string, reviewed_at long, atom_id string")
HEARTBEAT = _schema("event string, last_invoked_at string, last_outcome string, invocations int")
REPO_STATE = _schema("repo_id string, root_path string, last_indexed_sha string, last_indexed_at long, last_branch string, last_atoms_skipped int, last_ingest_notes array<string>")

SESSION_STATE = _schema("session_id string, started_at long, ended_at long, ended_reason string, context_pct_end double, handoff_path string, branch string, last_commit_sha string")
SCHEMA_VERSION_TABLE = _schema("version int, applied_at long")

TABLES = {"atoms": ATOMS, "atom_summaries": SUMMARIES, "edges": EDGES, "edge_evidence": EVIDENCE, "atom_vectors": VECTORS, "retrieval_log": RETRIEVAL_LOG, "candidates": CANDIDATES, "hook_heartbeat": HEARTBEAT, "repo_state": REPO_STATE, "session_state": SESSION_STATE, "schema_version": SCHEMA_VERSION_TABLE}
