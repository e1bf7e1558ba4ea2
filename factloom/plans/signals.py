"""Retrieval, text, screening and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guard
from ..functions import text as X
from ..operators import candidates, near, planning, retrieval
from .registry import query, seconds

COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT query_id, vec_id, cosine, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE rank <= 10")
def vector_topk(t):
    queries = t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(t.embeddings.select("vec_id", "embedding"), queries, 10, ident="vec_id", vector="embedding")


@query(f"SELECT query_id, vec_id, cosine, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_topk_batch(t):
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k(t.embeddings.select("vec_id", "embedding"), queries, 5, ident="vec_id", vector="embedding")


def relevances(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("relevance"), (F.col("label") == 0).alias("scaffolding"))


REL = f"WITH r AS (SELECT e.vec_id, {COS} AS relevance, e.label = 0 AS scaffolding FROM embeddings e, embeddings q WHERE q.vec_id = 0), g AS (SELECT *, CASE WHEN scaffolding THEN 'scaffolding' WHEN relevance >= 0 AND relevance < 0.25 THEN 'suppressed' ELSE 'kept' END AS verdict FROM r)"


@query(f"{REL} SELECT vec_id, relevance, verdict FROM g")
def relevance_gate(t):
    return retrieval.gated(relevances(t), 0.25).select("vec_id", "relevance", "verdict")


@query(f"{REL} SELECT count(*) FILTER (WHERE verdict = 'kept') AS n_kept, count(*) FILTER (WHERE verdict = 'suppressed') AS n_suppressed, count(*) FILTER (WHERE verdict = 'scaffolding') AS n_scaffolding, max(relevance) FILTER (WHERE verdict <> 'scaffolding') AS top_relevance, count(*) FILTER (WHERE verdict = 'kept') = 0 AND count(*) FILTER (WHERE verdict = 'suppressed') > 0 AS silenced FROM g")
def gate_summary(t):
    return retrieval.gate_summary(retrieval.gated(relevances(t), 0.25))


@query(f"{REL} SELECT vec_id AS node, round(score / sum(score) OVER (), 9) AS p FROM (SELECT vec_id, CASE WHEN vec_id IN (3, 5) THEN 1.0 ELSE relevance END AS score FROM r WHERE relevance > 0 OR vec_id IN (3, 5))")
def seed_normalise(t):
    scores = relevances(t).select(F.col("vec_id").alias("node"), F.col("relevance").alias("score"))
    exact = t.embeddings.where("vec_id in (3, 5)").select(F.col("vec_id").alias("node"))
    return retrieval.seeds(scores, exact).select("node", F.round("p", 9).alias("p"))


@query("""WITH d AS (SELECT source, doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM d),
m AS (SELECT *, max(running > 3000) OVER (PARTITION BY source ORDER BY doc_id) AS over FROM r) SELECT source, doc_id, tokens, CAST(running AS BIGINT) AS running FROM m WHERE NOT over""")
def token_budget_cut(t):
    rows = t.documents.select("source", "doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return retrieval.within_budget(rows, order=["doc_id"], tokens="tokens", cap=3000, group=["source"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unembedded_anti(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def same_model_semi(t):
    return t.documents.select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("SELECT event_type, list_sort(list(value))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)] AS p95, list_sort(list(value))[1 + CAST(round_even(0.25 * (count(*) - 1), 0) AS BIGINT)] AS p25 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_nearest(t):
    return retrieval.nearest_ranks(t.events, {"p95": 0.95, "p25": 0.25}, value="value", group=["event_type"]).drop("n")


def _calibrate_sql(add: str) -> str:
    return f"""WITH t AS (SELECT DISTINCT event_type FROM events ORDER BY event_type LIMIT 2), b AS (SELECT min(event_type) AS g, max(event_type) AS n FROM t),
v AS (SELECT list_sort(list(value + {add}) FILTER (WHERE event_type = (SELECT g FROM b))) AS g, list_sort(list(value) FILTER (WHERE event_type = (SELECT n FROM b))) AS n FROM events),
p AS (SELECT len(g) AS n_genuine, g[1 + CAST(round_even(0.25 * (len(g) - 1), 0) AS BIGINT)] AS genuine_p25, n[1 + CAST(round_even(0.95 * (len(n) - 1), 0) AS BIGINT)] AS nonsense_p95 FROM v),
s AS (SELECT CAST(n_genuine AS INTEGER) AS n_genuine, genuine_p25, nonsense_p95, CASE WHEN n_genuine < 20 THEN 'insufficient_data' WHEN genuine_p25 <= nonsense_p95 THEN 'not_separable' ELSE 'ok' END AS status FROM p)
SELECT *, CASE WHEN status = 'ok' THEN round_even(nonsense_p95 + 0.25 * (genuine_p25 - nonsense_p95), 4) END AS floor FROM s"""


def _calibrate(t, add: float):
    two = t.events.select("event_type").distinct().orderBy("event_type").limit(2).agg(F.min("event_type").alias("g"), F.max("event_type").alias("n"))
    rows = t.events.where("value is not null").join(F.broadcast(two), (F.col("event_type") == F.col("g")) | (F.col("event_type") == F.col("n")))
    genuine = F.col("event_type") == F.col("g")
    return retrieval.calibrated(rows.select(F.when(genuine, "genuine").otherwise("nonsense").alias("kind"), F.when(genuine, F.col("value") + add).otherwise(F.col("value")).alias("value")))


@query(_calibrate_sql("0.0"))
def calibrate_floor(t):
    return _calibrate(t, 0.0)


@query(_calibrate_sql("500.0"))
def calibrate_floor_separable(t):
    return _calibrate(t, 500.0)


@query("SELECT event_type AS event, count(*) AS invocations, max(epoch_us(ts) // 1000000) AS last_at, arg_max(user_id, {'t': epoch_us(ts) // 1000000, 'e': event_id}) AS last_outcome FROM events GROUP BY event_type")
def heartbeat_counts(t):
    rows = t.events.select("event_type", "event_id", "user_id", seconds("ts").alias("at"))
    return planning.heartbeats(rows, event="event_type", at="at", outcome="user_id", order=["event_id"])


@query("WITH l AS (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS t, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS before FROM events), b AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before >= 90 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t, event_id) AS burst FROM l) SELECT event_type, CAST(burst AS BIGINT) AS burst, count(*) AS n FROM b GROUP BY ALL")
def debounce_bursts(t):
    rows = t.events.select("event_id", "event_type", seconds("ts").alias("at"))
    return planning.debounced(rows, key=["event_type"], at="at", order=["event_id"]).groupBy("event_type", "burst").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM l WHERE before IS NULL OR before <> event_type")
def housekeeping_changes(t):
    return planning.changes_of(t.events, key=["user_id"], signature="event_type", order=["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM r WHERE n <= 40")
def last_messages(t):
    return planning.recent(t.conversations.where("role = 'user'"), key=["conv_id"], order=["turn"]).select("conv_id", "turn")


def _sql(pattern: str) -> str:
    """A pattern as a literal of DuckDB, without regard to case."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _when_sql(rules, value: int, default: str) -> str:
    text = "CASE " + " ".join(f"WHEN regexp_matches(text, {_sql(r[-1])}) THEN {r[value]!r}" for r in rules)
    return f"{text} ELSE {default} END"


@query(f"SELECT conv_id, turn, {_when_sql(X.PROMPT_CLASSES, 0, repr('semantic'))} AS class, CAST({_when_sql(X.PROMPT_CLASSES, 1, '0.3')} AS DOUBLE) AS confidence FROM conversations WHERE role = 'user'")
def prompt_classify(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", X.prompt_class(F.col("text")).alias("class"), X.prompt_confidence(F.col("text")).alias("confidence"))


_HITS = [(f"regexp_matches(text, {_sql(p)})", w) for _, w, p in X.SIGNALS]
_PENALTIES = f"""CASE WHEN regexp_matches(text, {_sql(X.IMPERATIVE)}) OR regexp_matches(text, {_sql(X.SPOKEN_IMPERATIVE)}) THEN -2 ELSE 0 END + CASE WHEN regexp_matches(text, {_sql(X.ADDRESSED)}) THEN -2 ELSE 0 END
+ CASE WHEN len(regexp_extract_all(text, {_sql(X.DEICTIC)})) >= 2 AND NOT {_HITS[0][0]} THEN -2 ELSE 0 END"""


@query(f"SELECT conv_id, turn, CAST(CASE WHEN length(text) BETWEEN 25 AND 400 AND NOT regexp_matches(text, '\\?\\s*$') AND ({' OR '.join(h for h, _ in _HITS)}) THEN {' + '.join(f'CASE WHEN {h} THEN {w} ELSE 0 END' for h, w in _HITS)} + {_PENALTIES} ELSE 0 END AS INTEGER) AS score FROM conversations")
def capture_score(t):
    return t.conversations.select("conv_id", "turn", X.capture_score(F.col("text")).alias("score"))


@query()
def capture_units(t):
    rows = candidates.clauses(t.conversations.where("role = 'user'"), keep=["conv_id", "turn"])
    return rows.select("conv_id", "turn", "at", "dropped", "score", X.proposed_type(F.col("signals")).alias("proposed_type"))


@query()
def captured_facts(t):
    rows = t.conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text")
    return candidates.captured(rows, threshold=1).select("fingerprint", "score", "proposed_type", F.array_join("signals", ",").alias("signals"))


@query(f"""WITH l AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C]'), lambda x: regexp_matches(x, '\\S')) AS lines FROM documents)
SELECT doc_id, length(text) > 3000 OR (len(lines) >= 4 AND (regexp_matches(text, '{X.MARKDOWN_TABLE}') OR len(list_filter(lines, lambda x: regexp_matches(x, '{X.MARKDOWN_LINE}'))) / len(lines) >= 0.3)) AS document FROM l""")
def document_shape(t):
    return t.documents.select("doc_id", X.looks_like_document(F.col("text")).alias("document"))


@query()
def guard_kinds(t):
    return t.documents.select("doc_id", F.array_join(guard.kinds(F.col("text")), ",").alias("kinds")).where("kinds <> ''")


@query()
def redact(t):
    return t.documents.select("doc_id", F.md5(guard.redacted(F.col("text")).cast("binary")).alias("redacted_md5"))


CREDENTIAL = r"""(?i)\b(password|passwd|secret|token|api_key|apikey)\b[ ]*[=:][ ]*["'][^"' ]{8,}["']"""
_CREDENTIAL_SQL = "'" + CREDENTIAL.replace("'", "''") + "'"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_CREDENTIAL_SQL})")
def guard_credential_native(t):
    """Quoted credentials alone, as an expression: what a scan without Python can tell."""
    return t.documents.where(F.col("text").rlike(CREDENTIAL)).select("doc_id")


@query("""WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tokens FROM documents), c AS (SELECT tokens, min(doc_id) AS rep FROM s WHERE len(tokens) > 0 GROUP BY tokens),
x AS (SELECT rep, len(tokens) AS n, unnest(tokens) AS w FROM c), p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.w = b.w AND a.rep < b.rep AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.6 UNION ALL SELECT rep, doc_id, 1.0 FROM s JOIN c USING (tokens) WHERE doc_id <> rep""")
def near_dup_jaccard(t):
    """Pairs between representatives of equal token sets, and the members of each."""
    return near.similar_pairs(t.documents, ident="doc_id", text="text", least=0.6)


@query()
def queue_many_greedy(t):
    return near.greedy(t.documents, ident="doc_id", text="text", least=0.6)


@query("""WITH g AS (SELECT doc_id, substr(lower(text), unnest(range(1, length(text) - 1)), 3) AS gram FROM documents),
s AS (SELECT doc_id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 384 AS slot, CASE WHEN CAST('0x' || substr(md5(gram), 9, 1) AS BIGINT) >= 8 THEN -1 ELSE 1 END AS sign FROM g),
v AS (SELECT doc_id, slot, sum(sign) AS raw FROM s GROUP BY 1, 2)
SELECT doc_id, slot, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def native_hash_embed(t):
    from ..functions.embed import hashed_grams

    return hashed_grams(t.documents, ident="doc_id", text="text")


@query()
def hash_embed_blake2s(t):
    from ..functions.embed import embed_rows

    return embed_rows(t.documents, ident="doc_id", text="text")
