"""Queries over the lifted store: views, mutations, joins, composites, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embed, guard
from ..functions import text as X
from ..operators import candidates, compose, discovery, graph, health, liveness, merge, planning, retrieval, sync, temporal
from ..operators.stage import cut
from ..sources import files, ingest, jsonl, store
from .lift import NOW, lifted, twin
from .registry import query, seconds

LIVE = "valid_to IS NULL AND NOT archived"


# --- views and lookups ------------------------------------------------------------------------------------


@query(twin("atoms", "summaries") + "SELECT a.id, a.type, s10.text AS text_10, s50.text AS text_50 FROM atoms a LEFT JOIN summaries s10 ON s10.atom_id = a.id AND s10.resolution = 10 LEFT JOIN summaries s50 ON s50.atom_id = a.id AND s50.resolution = 50 WHERE a.id = 'A17' AND NOT archived")
def get_atom(t):
    found = store.get_atom(lifted(t, "atoms"), lifted(t, "summaries"), "A17")
    return found.select("id", "type", F.col("summaries")[10].alias("text_10"), F.col("summaries")[50].alias("text_50"))


@query(twin("atoms") + f"SELECT id, confidence FROM atoms WHERE {LIVE} AND type = 'decision' AND coalesce(decision_class, 'constraint') = 'constraint' ORDER BY confidence DESC, id LIMIT 40")
def query_constraints(t):
    return temporal.query_atoms(lifted(t, "atoms"), where={"type": "decision", "decision_class": "constraint"}, order_by="confidence DESC", limit=40).select("id", "confidence")


@query(twin("edges") + "SELECT id, kind, weight FROM edges WHERE (src_id = 'A8' OR dst_id = 'A8') AND status = 'live' AND valid_to IS NULL ORDER BY weight DESC, id DESC LIMIT 200")
def list_edges(t):
    return compose.list_edges(lifted(t, "edges"), "A8").select("id", "kind", "weight")


@query(twin("atoms") + f"SELECT min(id) AS id FROM atoms WHERE {LIVE} AND topic_key = (SELECT min(topic_key) FROM (SELECT topic_key FROM atoms WHERE {LIVE} GROUP BY 1 HAVING count(*) = 1)) HAVING count(*) = 1")
def resolve_topic(t):
    atoms = lifted(t, "atoms")
    topic = temporal.live(atoms).groupBy("topic_key").agg(F.count(F.lit(1)).alias("n")).where("n = 1").agg(F.min("topic_key")).first()[0]
    found = store.resolve(atoms, topic) if topic is not None else None
    return t._spark.createDataFrame([(found,)] if found is not None else [], "id string")  # no topic of one atom: no row


@query(twin("atoms") + f"SELECT DISTINCT topic_key FROM atoms WHERE {LIVE} AND type = 'decision'")
def topics_in(t):
    return temporal.topics_in(lifted(t, "atoms"), kind="decision")


@query(twin("atoms") + "SELECT id, CASE WHEN source_kind = 'commit' THEN NULL ELSE regexp_replace(source_ref, ':[0-9]+$', '') END AS path, CASE WHEN topic_key LIKE 'symbol:%' THEN regexp_extract(topic_key, '([^:]*)$', 1) END AS symbol, topic_key LIKE 'module:%' OR topic_key LIKE 'symbol:%/tests/%' AS scaffolding FROM atoms")
def source_paths(t):
    return lifted(t, "atoms").select("id", compose.source_path().alias("path"), compose.symbol_name().alias("symbol"), compose.scaffolding(F.col("topic_key")).alias("scaffolding"))


@query(twin("candidates") + "SELECT fingerprint, score FROM candidates WHERE status = 'pending' ORDER BY score DESC, created_at, fingerprint LIMIT 50")
def pending_queue(t):
    return candidates.pending(lifted(t, "candidates")).select("fingerprint", "score")


@query(twin("candidates") + "SELECT min(fingerprint) AS fingerprint FROM candidates WHERE fingerprint LIKE (SELECT substr(min(fingerprint), 1, 12) FROM candidates) || '%' HAVING count(*) = 1")
def fingerprint_prefix(t):
    rows = lifted(t, "candidates")
    prefix = rows.agg(F.substring(F.min("fingerprint"), 1, 12)).first()[0]
    return candidates.by_prefix(rows, prefix).select("fingerprint")


# --- mutations ----------------------------------------------------------------------------------------------


@query(twin("atoms") + "SELECT id, CASE WHEN confidence > 0.9 THEN 'confidence outside [0, 1]' ELSE 'decision without status' END AS error FROM atoms WHERE confidence > 0.9 OR (type = 'decision' AND decision_status = 'OPEN')")
def rejected_atoms(t):
    rows = lifted(t, "atoms").withColumns({"confidence": F.when(F.col("confidence") > 0.9, 1.5).otherwise(F.col("confidence")), "decision_status": F.when(F.col("decision_status") != "OPEN", F.col("decision_status"))})
    return temporal.validated(rows)[1].select("id", "error")


@query(twin("atoms") + f"SELECT id, CASE WHEN id = 'A3' THEN coalesce(valid_to, {NOW}) ELSE valid_to END AS valid_to, CASE WHEN id = 'A3' THEN 'A5' ELSE superseded_by END AS superseded_by FROM atoms")
def supersede_by_hand(t):
    pairs = t._spark.createDataFrame([("A3", "A5"), ("A4", "gone")], "old string, new string")
    return temporal.superseded(lifted(t, "atoms"), pairs, NOW).select("id", "valid_to", "superseded_by")


@query(twin("atoms") + "SELECT id, pinned OR type = 'invariant' AS pinned FROM atoms")
def pinned_invariants(t):
    atoms = lifted(t, "atoms")
    return compose.flagged(atoms, atoms.where("type = 'invariant'"), "pinned").select("id", "pinned")


@query(twin("summaries", "atoms") + """, n AS (SELECT id AS atom_id, 50 AS resolution, 'new ' || topic_key AS text FROM atoms WHERE type = 'glossary')
SELECT atom_id, resolution, text, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS token_count FROM n UNION ALL SELECT atom_id, resolution, text, token_count FROM summaries WHERE (atom_id, resolution) NOT IN (SELECT atom_id, resolution FROM n)""")
def summaries_upserted(t):
    atoms = lifted(t, "atoms")
    new = atoms.where("type = 'glossary'").select(F.col("id").alias("atom_id"), F.lit(50).alias("resolution"), F.concat(F.lit("new "), "topic_key").alias("text"))
    wrong = t._spark.createDataFrame([("A1", 60, "x"), ("nobody", 50, "x")], "atom_id string, resolution int, text string")
    return store.summaries_upserted(lifted(t, "summaries"), new.unionByName(wrong), atoms)[0]


@query(twin("edges") + """, r AS (SELECT CASE WHEN kind IN ('CONTRADICTS', 'MIRRORS') AND src_id > dst_id THEN dst_id ELSE src_id END AS src_id, CASE WHEN kind IN ('CONTRADICTS', 'MIRRORS') AND src_id > dst_id THEN src_id ELSE dst_id END AS dst_id, kind, weight, status, CAST(substr(id, 2) AS BIGINT) AS seq FROM edges)
SELECT src_id, dst_id, kind, max(weight) AS weight, arg_max(status, seq) AS status FROM r GROUP BY 1, 2, 3""")
def edges_upserted(t):
    rows = lifted(t, "edges").withColumn("seq", F.substring("id", 2, 20).cast("long"))
    return merge.upserted_edges(rows).select("src_id", "dst_id", "kind", "weight", "status")


@query(twin("atoms") + f"SELECT 'A1' AS src_id, id AS dst_id, CASE WHEN starts_with(source_ref, 'd1') THEN 'd1' ELSE 'd2/' END AS evidence FROM atoms WHERE {LIVE} AND id <> 'A1' AND (starts_with(source_ref, 'd1') OR starts_with(source_ref, 'd2/'))")
def blocks_edges(t):
    return compose.blocks(lifted(t, "atoms"), "A1", ["d1", "d2/"]).select("src_id", "dst_id", "evidence")


@query(twin("edges", "evidence") + f"SELECT id, CASE WHEN id IN (SELECT edge_id FROM evidence WHERE payload LIKE '%5%') THEN coalesce(valid_to, {NOW}) ELSE valid_to END AS valid_to FROM edges")
def edges_expired(t):
    ids = lifted(t, "evidence").where(F.col("payload").contains("5")).select(F.col("edge_id").alias("id"))
    return compose.closed_edges(lifted(t, "edges"), ids, NOW).select("id", "valid_to")


@query(twin("evidence", "edges") + "SELECT edge_id, kind, payload FROM evidence UNION SELECT id, 'symbol', kind FROM edges WHERE status = 'live'")
def evidence_added(t):
    edges = lifted(t, "edges")
    new = edges.where("status = 'live'").select(F.col("id").alias("edge_id"), F.lit("symbol").alias("kind"), F.col("kind").alias("payload"), F.lit(NOW).cast("long").alias("created_at"))
    again = lifted(t, "evidence")
    return compose.with_evidence(again, edges, new.unionByName(again)).select("edge_id", "kind", "payload")


@query(twin("candidates") + f"SELECT fingerprint, CASE WHEN status <> 'pending' THEN status WHEN score >= 4 THEN 'accepted' WHEN score = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' AND (score >= 4 OR score = 0) THEN {NOW} END AS reviewed_at FROM candidates")
def review(t):
    rows = lifted(t, "candidates")
    verdicts = rows.select("fingerprint", F.when(F.col("score") >= 4, "accepted").when(F.col("score") == 0, "rejected").alias("verdict"))
    return candidates.reviewed(rows, verdicts, NOW)[0].select("fingerprint", "status", "reviewed_at")


@query(twin("candidates") + f"""SELECT 'convention_' || substr(sha1('convention' || chr(0) || 'captured:' || fingerprint || chr(0) || trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), 1, 12) AS id, 'captured:' || fingerprint AS topic_key, {NOW + 90 * 86400} AS confirm_by FROM candidates WHERE status = 'pending' AND score >= 4""")
def accepted_atoms(t):
    rows = lifted(t, "candidates")
    verdicts = rows.select("fingerprint", F.when(F.col("score") >= 4, "accepted").otherwise("rejected").alias("verdict"))
    return candidates.reviewed(rows, verdicts, NOW)[1].select("id", "topic_key", "confirm_by")


@query("SELECT user_id AS session_id, min(epoch_us(ts) // 1000000) AS started_at, arg_max(event_type, {'t': ts, 'e': event_id}) AS ended_reason FROM events GROUP BY user_id")
def sessions_recorded(t):
    rows = t.events.select(F.col("user_id").alias("session_id"), seconds("ts").alias("started_at"), F.col("event_type").alias("ended_reason"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    newest = rows.withColumn("place", F.struct("at", "event_id"))
    half = newest.where("event_id % 2 = 0"), newest.where("event_id % 2 = 1")
    last = store.upsert(half[0], half[1], ["session_id"], "place")
    first = store.record_session(half[0].drop("place", "at"), half[1].drop("place", "at")).select("session_id", "started_at")
    # the last word by time over both halves; the first start over both
    return first.join(jsonl.keep_last(half[0].unionByName(half[1]), ["session_id"], ["place"]).select("session_id", "ended_reason"), "session_id").join(last.select("session_id"), "session_id", "left_semi")


@query(twin("atoms") + "SELECT id, coalesce(tier, 'symbol') AS tier, workspace_id, CASE WHEN type = 'decision' THEN CASE WHEN source_kind = 'commit' THEN 'change' ELSE 'constraint' END END AS decision_class FROM atoms")
def migrated_atoms(t):
    old = lifted(t, "atoms").drop("tier", "decision_class", "workspace_id", "pinned", "archived", "confirm_by")
    return store.migrated_tables({"atoms": old})["atoms"].select("id", "tier", "workspace_id", "decision_class")


# --- joins ----------------------------------------------------------------------------------------------------


@query(twin("atoms", "summaries") + f"SELECT id, md5(coalesce((SELECT string_agg(text, ' ' ORDER BY resolution) FROM summaries s WHERE s.atom_id = a.id), '')) AS text_md5 FROM atoms a WHERE {LIVE}")
def atom_texts(t):
    return compose.atom_texts(lifted(t, "atoms"), lifted(t, "summaries")).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(twin("atoms", "edges") + f"SELECT id, topic_key FROM atoms WHERE {LIVE} AND contains(topic_key, 'f7.py') AND id IN (SELECT src_id FROM edges WHERE kind = 'MIRRORS' AND valid_to IS NULL UNION SELECT dst_id FROM edges WHERE kind = 'MIRRORS' AND valid_to IS NULL)")
def mirrors_lookup(t):
    return compose.mirrors_of(lifted(t, "atoms"), lifted(t, "edges"), "f7.py")


@query(twin("vectors", "atoms") + f"SELECT model, count(*) AS n FROM vectors JOIN atoms ON atom_id = id WHERE {LIVE} GROUP BY model")
def stored_models(t):
    return store.stored_models(lifted(t, "vectors"), lifted(t, "atoms"))


@query(twin("vectors", "atoms") + f"""SELECT (SELECT count(*) FROM atoms WHERE {LIVE}) AS live, (SELECT count(*) FROM vectors JOIN atoms ON atom_id = id WHERE {LIVE} AND model = 'm') AS embedded,
(SELECT count(*) FROM atoms WHERE {LIVE} AND id NOT IN (SELECT atom_id FROM vectors WHERE model = 'm')) AS unembedded, true AS mixed, false AS mismatch""")
def embed_status(t):
    return store.embed_status(lifted(t, "atoms"), lifted(t, "summaries"), lifted(t, "vectors"), "m").drop("models")


@query(twin("atoms", "summaries", "vectors") + f"""SELECT a.id FROM atoms a JOIN summaries s ON s.atom_id = a.id AND resolution = 50 LEFT JOIN vectors v ON v.atom_id = a.id WHERE {LIVE} AND (v.model IS NULL OR v.model <> 'm')
ORDER BY pinned DESC, type = 'decision' DESC, asserted_at DESC, id LIMIT 500""")
def embedding_queue(t):
    vectors = lifted(t, "vectors").join(lifted(t, "summaries").where("resolution = 50").select("atom_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("hash")), "atom_id", "left")
    return store.pending_embeddings(lifted(t, "atoms"), lifted(t, "summaries"), vectors.withColumn("hash", F.coalesce("hash", F.lit(""))), "m").select("id")


@query(twin("atoms", "edges", "evidence") + """, x AS (SELECT id, kind, weight, CASE WHEN src_id = 'A8' THEN 'out' ELSE 'in' END AS direction, CASE WHEN src_id = 'A8' THEN dst_id ELSE src_id END AS other FROM edges WHERE src_id = 'A8' OR dst_id = 'A8')
SELECT x.id, x.kind, direction, other, topic_key, v.payload FROM x LEFT JOIN atoms a ON a.id = other LEFT JOIN evidence v ON v.edge_id = x.id""")
def why(t):
    found = compose.why(lifted(t, "atoms"), lifted(t, "edges"), lifted(t, "evidence"), "A8")
    return found.select("id", "kind", "direction", "other", "topic_key", F.explode_outer("payloads").alias("payload"))


@query(twin("atoms", "edges") + f"""SELECT src_id, dst_id FROM (SELECT m.id AS dst_id, c.id AS src_id FROM (SELECT id, substr(topic_key, 8) AS dir FROM atoms WHERE {LIVE} AND topic_key LIKE 'module:%') m
JOIN atoms c ON (regexp_replace(c.source_ref, ':[0-9]+$', '') = dir OR starts_with(c.source_ref, dir || '/')) AND c.valid_to IS NULL AND NOT c.archived AND c.tier <> 'module' WHERE c.id <> m.id)""")
def module_edges(t):
    atoms = lifted(t, "atoms")
    modules = temporal.live(atoms).where("topic_key like 'module:%'").select("id", F.substring("topic_key", 8, 100).alias("directory"))
    return discovery.module_edges(modules, atoms).select("src_id", "dst_id")


@query(twin("atoms") + f"SELECT id, CASE WHEN valid_to IS NULL AND source_kind <> 'commit' AND regexp_replace(source_ref, ':[0-9]+$', '') = 'd6/f6.py' THEN {NOW} WHEN valid_to IS NULL AND source_ref = 'd3' AND topic_key LIKE 'module:%' AND source_kind <> 'commit' THEN {NOW} ELSE valid_to END AS valid_to FROM atoms")
def reaped(t):
    spark = t._spark
    deleted = spark.createDataFrame([("d6/f6.py",), ("d3/x.py",)], "path string")
    tracked = spark.createDataFrame([("d6/f7.py",), ("d4/y.py",)], "path string")
    return discovery.reaped(lifted(t, "atoms"), deleted, tracked, NOW).select("id", "valid_to")


# --- aggregates ---------------------------------------------------------------------------------------------


@query(twin("atoms", "candidates", "repos", "probes", "dirty") + f"""SELECT (SELECT count(*) FROM atoms WHERE {LIVE}) AS atoms, (SELECT count(*) FROM atoms WHERE {LIVE} AND coalesce(liveness_kind, 'none') <> 'none' AND (liveness_last_ok IS NULL OR liveness_last_ok < {NOW - 86400})) AS stale,
(SELECT count(*) FROM candidates WHERE status = 'pending') AS to_review, (SELECT sum(coalesce(commits_behind, 0)) FROM repos JOIN probes USING (repo_id)) AS behind""")
def pulse(t):
    drifts = planning.drift(lifted(t, "repos"), lifted(t, "probes"), lifted(t, "dirty"))
    return planning.pulse(lifted(t, "atoms"), lifted(t, "candidates"), drifts, NOW)


DRIFT = twin("repos", "probes", "dirty") + """, d AS (SELECT repo_id, last_indexed_at IS NULL AS never_indexed, is_git AND last_indexed_sha IS NOT NULL AND commits_behind IS NULL AS unknown_base,
  is_git AND last_indexed_at IS NOT NULL AND last_indexed_sha IS NULL AND head_sha IS NOT NULL AS indexed_without_head, coalesce(commits_behind, 0) AS behind, root_exists, is_git,
  (SELECT count(DISTINCT path) FROM dirty x WHERE x.repo_id = r.repo_id AND path NOT LIKE '.factloom%') AS dirty FROM repos r JOIN probes USING (repo_id)),
e AS (SELECT *, root_exists AND is_git AND (never_indexed OR unknown_base OR indexed_without_head OR behind > 0) AS drifted FROM d)"""


@query(DRIFT + " SELECT repo_id, never_indexed, unknown_base, indexed_without_head, behind, dirty, drifted FROM e")
def drift(t):
    return planning.drift(lifted(t, "repos"), lifted(t, "probes"), lifted(t, "dirty")).drop("description")


@query(DRIFT + " SELECT CAST(sum(behind) AS BIGINT) AS behind, CAST(sum(dirty) AS BIGINT) AS dirty, count(*) FILTER (WHERE drifted) AS n_drifted, 'index is ' || CAST(sum(behind) FILTER (WHERE drifted) AS BIGINT) || ' commit(s) behind HEAD across ' || count(*) FILTER (WHERE drifted AND behind > 0) || CASE WHEN count(*) FILTER (WHERE drifted AND behind > 0) = 1 THEN ' root' ELSE ' roots' END || '; ' || count(*) FILTER (WHERE drifted AND unknown_base) || ' root(s) indexed against a sha git cannot resolve; ' || count(*) FILTER (WHERE drifted AND never_indexed) || ' root(s) never indexed' AS summary FROM e")
def drift_summary(t):
    return planning.drift_summary(planning.drift(lifted(t, "repos"), lifted(t, "probes"), lifted(t, "dirty")))


@query(twin("log") + """SELECT count(*) AS n, count(*) FILTER (WHERE n_suppressed > 0 AND atoms_returned IS NULL) AS silenced, count(*) FILTER (WHERE n_suppressed > 0) AS gated,
count(*) FILTER (WHERE n_suppressed > 0 AND atoms_returned IS NULL AND top_relevance >= min_relevance - 0.05) AS near_miss, (SELECT arg_max(min_relevance, id) FROM log WHERE min_relevance IS NOT NULL) AS floor FROM log WHERE top_relevance IS NOT NULL AND min_relevance IS NOT NULL""")
def calibration_health(t):
    return health.calibration_counts(lifted(t, "log"))


@query(twin("log") + "SELECT query, max(ts) AS last_seen FROM log WHERE length(trim(query)) > 2 GROUP BY query ORDER BY last_seen DESC, query LIMIT 200")
def logged_queries(t):
    return compose.genuine_queries(lifted(t, "log"), 200)


@query(twin("log") + f"""SELECT atom_id FROM (SELECT ts, id, unnest(atoms_returned) AS atom_id, generate_subscripts(atoms_returned, 1) AS place FROM log WHERE ts >= {NOW - 36000} AND atoms_returned IS NOT NULL) GROUP BY atom_id ORDER BY min({{'t': -ts, 'i': id, 'a': place}}) LIMIT 50""")
def handed_over(t):
    return compose.handed_over(lifted(t, "log"), NOW - 36000)


@query(twin("atoms") + f"SELECT id, type, topic_key FROM atoms WHERE created_at >= {NOW - 90000} AND NOT archived ORDER BY created_at DESC, id LIMIT 30")
def drafted(t):
    return compose.drafted(lifted(t, "atoms"), NOW - 90000)


# --- composites -------------------------------------------------------------------------------------------------


@query(twin("atoms") + f""", i AS (SELECT *, 0 AS part FROM atoms WHERE {LIVE} AND type = 'invariant' ORDER BY confidence DESC, id LIMIT 5), d AS (SELECT *, 1 AS part FROM atoms WHERE {LIVE} AND type = 'decision' AND decision_status = 'CLOSED' AND coalesce(decision_class, 'constraint') = 'constraint' ORDER BY confidence DESC, id LIMIT 5),
b AS (SELECT * FROM i UNION ALL SELECT * FROM d WHERE (SELECT count(*) FROM i) < 5) SELECT id, type, topic_key, pinned, CAST(row_number() OVER (ORDER BY pinned DESC, part, confidence DESC, id) AS INTEGER) AS place FROM b QUALIFY place <= 5""")
def digest(t):
    return planning.digest(lifted(t, "atoms")).select("id", "type", "topic_key", "pinned", "place")


@query(twin("atoms", "edges") + f""", s AS (SELECT id, topic_key FROM atoms WHERE {LIVE} AND tier = 'module'), x AS (SELECT id AS e, dst_id AS id, src_id AS other, kind, weight FROM edges WHERE valid_to IS NULL AND status = 'live' UNION ALL SELECT id, src_id, dst_id, kind, weight FROM edges WHERE valid_to IS NULL AND status = 'live'),
n AS (SELECT x.* FROM x JOIN s USING (id) QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY weight DESC, e DESC) <= 100),
j AS (SELECT n.id, n.other, n.kind, a.decision_status, n.kind = 'OWNS' AND a.type = 'owner' AS owner, NOT (n.kind = 'OWNS' AND a.type = 'owner') AND ((n.kind = 'BLOCKS' AND a.type = 'decision') OR n.kind = 'CONTRADICTS' OR a.type = 'invariant' OR (a.type = 'decision' AND a.decision_class = 'constraint')) AS relevant FROM n JOIN atoms a ON a.id = n.other WHERE NOT a.archived)
SELECT s.id, count(DISTINCT other) FILTER (WHERE relevant) AS n_constraints, count(DISTINCT other) FILTER (WHERE owner) AS n_owners, count(*) FILTER (WHERE kind = 'CONTRADICTS' OR (kind = 'BLOCKS' AND decision_status = 'CLOSED' AND relevant)) > 0 AS blocked FROM s LEFT JOIN j USING (id) GROUP BY s.id""")
def plan_surfaces(t):
    atoms = lifted(t, "atoms")
    surface = temporal.live(atoms).where("tier = 'module'").select("id", planning.surface_title().alias("title"), F.lit("seed").alias("trail"))
    found = planning.plan(surface, atoms, lifted(t, "edges"), lifted(t, "summaries"))
    return found.select("id", F.size("constraints").cast("long").alias("n_constraints"), F.size("owners").cast("long").alias("n_owners"), "blocked")


@query()
def plan_document(t):
    atoms = lifted(t, "atoms")
    surface = temporal.live(atoms).where("tier = 'module' and pinned").select("id", planning.surface_title().alias("title"), F.lit("seed").alias("trail"))
    return planning.plan_report("tidy the modules", planning.plan(surface, atoms, lifted(t, "edges"), lifted(t, "summaries")))


@query()
def edge_case_findings(t):
    diff = t.pages.select(F.explode(F.split("html", "\n")).alias("line")).limit(0).unionByName(t._spark.createDataFrame([("+def alpha(x):",), ("-  beta(1)",), ("+++ b/x.py",), (" gamma()",)], "line string"))
    lines = t.documents.select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("path"), F.explode(F.split("text", r"\n")).alias("line"))
    return planning.edge_cases(planning.changed_symbols(diff), lines, t._spark.createDataFrame([("alpha", "A1")], "name string, id string"))


@query()
def retrieve_hits(t):
    atoms, edges = cut(lifted(t, "atoms")), lifted(t, "edges")
    q = t.embeddings.where("vec_id = 0").first()["embedding"]
    sources = atoms.where("liveness_target is not null").select(F.col("liveness_target").alias("path")).distinct().withColumn("text", F.lit("def Brand#11\ndef Brand#12"))
    found = compose.retrieve(atoms, edges, lifted(t, "vectors"), list(q), model="m", files=("d8/f8.py",), now=NOW, sources=sources)
    return found.select("id", F.round("score", 9).alias("score"), F.round("relevance", 6).alias("relevance"), "depth", "state")


@query()
def routed_lines(t):
    atoms = cut(lifted(t, "atoms"))
    vectors = embed.embed_rows(t.benchmark.select(F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("atom_id"), "text"), ident="atom_id", text="text").withColumn("model", F.lit("hash-3gram-v1"))
    lines, _ = compose.route("why does the part move", atoms, lifted(t, "edges"), cut(vectors), lifted(t, "summaries"), embed.HashEmbedder().embed, model="hash-3gram-v1", now=NOW)
    return lines.select("id", "line", "tokens", F.round("relevance", 6).alias("relevance"))


@query()
def relevance_floor(t):
    vectors = embed.embed_rows(t.benchmark.select(F.concat(F.lit("A"), F.col("item_id").cast("string")).alias("atom_id"), "text"), ident="atom_id", text="text").withColumn("model", F.lit("hash-3gram-v1"))
    log = t.benchmark.select(F.col("item_id").alias("id"), (F.lit(NOW) - F.col("item_id")).alias("ts"), F.substring("text", 1, 60).alias("query"))
    found = compose.derived_floor(log, cut(lifted(t, "atoms")), lifted(t, "edges"), cut(vectors), embed.HashEmbedder().embed, model="hash-3gram-v1", now=NOW, limit=40)
    return found.select("n_genuine", "status", F.round("genuine_p25", 6).alias("genuine_p25"), F.round("nonsense_p95", 6).alias("nonsense_p95"), "floor")


def _halves(t):
    tables = {"atoms": lifted(t, "atoms").withColumn("valid_in_refs", F.array("repo_id")), "atom_summaries": lifted(t, "summaries"), "edges": lifted(t, "edges").drop("id")}
    tables["edge_evidence"] = sync.with_edge_keys(lifted(t, "evidence"), lifted(t, "edges"))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    key = {"atoms": number("id"), "atom_summaries": number("atom_id"), "edges": number("src_id"), "edge_evidence": number("edge_src")}
    ours = {n: df.where(key[n] % 3 != 0) for n, df in tables.items()}
    theirs = {n: df.where(key[n] % 3 != 1) for n, df in tables.items()}
    theirs["atoms"] = theirs["atoms"].withColumns({"pinned": F.lit(True), "valid_to": F.coalesce(F.col("valid_to") - 100, F.when(number("id") % 5 == 0, F.lit(NOW)))})
    return ours, theirs


@query(twin("atoms") + f""", h AS (SELECT id, CAST(substr(id, 2) AS BIGINT) AS k, valid_to, pinned FROM atoms), o AS (SELECT id, valid_to, pinned FROM h WHERE k % 3 <> 0 UNION ALL SELECT id, coalesce(valid_to - 100, CASE WHEN k % 5 = 0 THEN {NOW} END), true FROM h WHERE k % 3 <> 1)
SELECT id, min(valid_to) AS valid_to, bool_or(pinned) AS pinned FROM o GROUP BY id""")
def sync_merge(t):
    ours, theirs = _halves(t)
    return sync.merged(ours, theirs)["atoms"].select("id", "valid_to", "pinned")


@query(twin("atoms", "edges") + """, a AS (SELECT CAST(substr(id, 2) AS BIGINT) % 3 AS m, CAST(substr(id, 2) AS BIGINT) % 5 AS f, valid_to, pinned FROM atoms), e AS (SELECT DISTINCT src_id, dst_id, kind, valid_from, CAST(substr(src_id, 2) AS BIGINT) % 3 AS m FROM edges)
SELECT 'atoms' AS "table", count(*) FILTER (WHERE m = 0) AS inserted, count(*) FILTER (WHERE m = 2 AND NOT (pinned AND valid_to IS NULL AND f <> 0)) AS updated, count(*) FILTER (WHERE m = 2 AND pinned AND valid_to IS NULL AND f <> 0) AS unchanged FROM a
UNION ALL SELECT 'edges', count(*) FILTER (WHERE m = 0 AND dst_id IN (SELECT id FROM atoms)), 0, count(*) FILTER (WHERE m = 2 AND dst_id IN (SELECT id FROM atoms)) FROM e""")
def import_counts(t):
    ours, theirs = _halves(t)
    return sync.imported(ours, theirs, NOW)[1]


@query(twin("atoms") + ", l AS (SELECT * FROM atoms WHERE valid_to IS NULL), k AS (SELECT type, topic_key, workspace_id, arg_min(id, {'v': -valid_from, 'i': id}) AS kept, arg_min(source_kind, {'v': -valid_from, 'i': id}) AS sk FROM l GROUP BY ALL HAVING count(*) > 1) SELECT topic_key, kept, l.id AS closed FROM l JOIN k USING (type, topic_key, workspace_id) WHERE l.id <> kept AND NOT (l.source_kind IN ('commit', 'manifest') AND sk IN ('commit', 'manifest'))")
def sync_conflicts(t):
    return sync.reconciled(lifted(t, "atoms"), NOW)[1]


@query()
def merged_export(t):
    ours, theirs = _halves(t)
    lines = [sync.rendered_tables(side).select(F.col("line").alias("value")) for side in (ours, theirs)]
    merged = sync.merged_lines(*lines)
    return merged.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("line"), F.lit(1_000_003))).alias("digest"))


@query("SELECT substr(right('A-' || o_orderkey, 12), 1, 2) AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_rows(t):
    rows = t.orders.select(F.concat(F.lit("A-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("status"))
    return jsonl.sharded_lines(rows, "atoms").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT substr(right('A-' || o_orderkey, 12), 1, 4) AS shard FROM orders WHERE o_orderkey % 50 = 0")
def shards_changed(t):
    rows = t.orders.select(F.concat(F.lit("A-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    now = rows.withColumn("status", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("status"))).drop("o_orderkey")
    return jsonl.changed_shards(jsonl.sharded_lines(now, "atoms", length=4), jsonl.sharded_lines(rows.drop("o_orderkey"), "atoms", length=4))


# --- guard, liveness, health, sources ---------------------------------------------------------------------------


@query(twin("atoms", "summaries", "edges") + """, b AS (SELECT DISTINCT atom_id AS id FROM summaries WHERE text LIKE '%joe@corp.org%') SELECT 'atoms' AS "table", count(*) AS n FROM atoms WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'atom_summaries', count(*) FROM summaries WHERE atom_id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE src_id NOT IN (SELECT id FROM b) AND dst_id NOT IN (SELECT id FROM b)""")
def guard_withhold(t):
    tables, _ = store.guard_withheld(lifted(t, "atoms"), lifted(t, "summaries"), lifted(t, "edges"), lifted(t, "evidence"), guard.kinds)
    out = None
    for name in ("atoms", "atom_summaries", "edges"):
        one = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _files(t):
    """Documents as files of ten sources, each with a line that some predicates look for."""
    return t.documents.select(F.concat(F.lit("d"), F.pmod("doc_id", F.lit(20)).cast("string"), F.lit("/f"), F.pmod("doc_id", F.lit(40)).cast("string"), F.lit(".py")).alias("path"), "doc_id").groupBy("path").agg(F.concat(F.lit("def Brand#"), F.max("doc_id").cast("string"), F.lit("\n\ndef Brand#1")).alias("text"))


@query(twin("atoms") + """, f AS (SELECT 'd' || (doc_id % 20) || '/f' || (doc_id % 40) || '.py' AS path, 'def Brand#' || max(doc_id) || chr(10) || chr(10) || 'def Brand#1' AS text FROM documents GROUP BY 1)
SELECT id, CASE WHEN coalesce(liveness_kind, 'none') = 'none' THEN 'none' WHEN liveness_pattern <> '(' AND contains(text, liveness_pattern) THEN 'verified' ELSE 'failed' END AS state FROM atoms LEFT JOIN f ON path = liveness_target""")
def liveness_regex(t):
    return liveness.checked(lifted(t, "atoms"), _files(t), now=NOW).select("id", "state")


@query()
def liveness_sweep(t):
    atoms, runs = liveness.swept(cut(lifted(t, "atoms").where("liveness_kind = 'regex'")), _files(t), now=NOW, batch=500, most=3)
    return atoms.agg(F.count_if(F.col("liveness_last_ok") == NOW).alias("verified"), F.lit(runs).alias("runs"))


@query(twin("atoms") + f"SELECT id, topic_key FROM atoms WHERE {LIVE} AND coalesce(liveness_kind, 'none') <> 'none' AND (liveness_target = 'd6/f6.py' OR regexp_replace(source_ref, ':[0-9]+$', '') = 'd6/f6.py')")
def watched(t):
    paths = t._spark.createDataFrame([("d6/f6.py",)], "path string")
    return liveness.watched(lifted(t, "atoms"), _files(t), paths, now=NOW).select("id", "topic_key")


@query(twin("candidates") + "SELECT fingerprint FROM candidates WHERE FALSE")
def excluded_terms(t):
    rows = t.conversations.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    found = candidates.captured(rows, threshold=99, exclude_terms=("nobody",))
    return found.select("fingerprint")


@query()
def queue_noise(t):
    return candidates.noise(lifted(t, "candidates").where("score >= 5"))


@query()
def doctor_report(t):
    """All checks on the lifted store; what the driver's tables have no stand-in for could not run and fails."""
    spark = t._spark
    tables = {"atoms": lifted(t, "atoms"), "edges": lifted(t, "edges"), "atom_summaries": lifted(t, "summaries"), "atom_vectors": lifted(t, "vectors"), "retrieval_log": lifted(t, "log"), "candidates": lifted(t, "candidates"), "repo_state": lifted(t, "repos"), "probes": lifted(t, "probes"), "dirty": lifted(t, "dirty")}
    tables["schema_version"] = spark.createDataFrame([(store.SCHEMA_VERSION,)], "version int")
    tables["settings"] = spark.createDataFrame([("m",)], "model string")
    tables["hook_heartbeat"] = t.events.groupBy(F.col("event_type").alias("event")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_invoked_at"))
    return health.report(spark, tables, NOW)


@query("SELECT conv_id AS session_id, turn, text FROM conversations WHERE role = 'user' AND turn % 4 <> 2 AND regexp_matches(text, '[^ \\t\\n\\r]')")
def transcript_messages(t):
    content = F.struct(F.struct(F.col("role"), F.col("text").alias("content")).alias("message"), F.col("role").alias("type"), F.concat_ws("/", "conv_id", "turn").alias("sessionId"), F.when(F.col("turn") % 4 == 2, "sdk").when(F.col("turn") % 4 == 0, "typed").alias("promptSource"))
    lines = t.conversations.select(F.to_json(content).alias("value")).unionByName(t._spark.createDataFrame([('{"type": "user", "mess',)], "value string"))
    part = F.split("session_id", "/")
    return jsonl.transcript_messages(lines).select(part[0].cast("long").alias("session_id"), part[1].cast("long").alias("turn"), "text")


@query()
def ingested_symbols(t):
    """Symbol facts of files made of the documents' texts."""
    rows = t.documents.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("():\n  pass\n"), F.coalesce("text", F.lit(""))).alias("text"))
    source = ingest.Input(rows, now=NOW)
    return ingest.run(source, ["symbols"])["symbols"].rows.select("id", "topic_key", "claim", "liveness_pattern")


@query("SELECT c_mktsegment AS segment, count(*) AS behind FROM customer GROUP BY 1")
def commits_behind(t):
    """Each market segment is a repo whose log is its customers; the base is its first commit but one."""
    out = None
    for r in t.customer.select("c_mktsegment").distinct().collect():  # five segments
        log = t.customer.where(F.col("c_mktsegment") == r[0]).select(F.col("c_custkey").cast("string").alias("sha"), F.col("c_custkey").alias("ts"))
        base = t._spark.createDataFrame([("base", -1)], "sha string, ts long")
        one = t._spark.createDataFrame([(r[0], store.commits_behind(log.unionByName(base), "base"))], "segment string, behind long")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_name AS module, count(*) AS files FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 1 LIMIT 100")
def source_modules(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.lit("/"), "s_name", F.lit(".py")).alias("path"))
    return files.modules(rows)


@query("SELECT doc_id, round((SELECT sum(c / length(w) * log2(length(w) / c)) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(w, '')) AS ch) GROUP BY ch)), 6) AS bits FROM (SELECT doc_id, substr(text, 1, 40) AS w FROM documents WHERE length(text) >= 40)")
def token_entropy(t):
    from pyspark.sql.functions import pandas_udf

    bits = pandas_udf(lambda s: s.map(guard.entropy), "double")
    return t.documents.where(F.length("text") >= 40).select("doc_id", F.round(bits(F.substring("text", 1, 40)), 6).alias("bits"))


@query()
def reach_graph_batch(t):
    """Rank of a batch of seeds in one iteration."""
    seeds = lifted(t, "atoms").where("id in ('A1', 'A2', 'A3')").select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(1.0).alias("p"))
    adj = cut(graph.adjacency(lifted(t, "edges").where("valid_to is null and status = 'live'")))
    return graph.pagerank(adj, seeds, per=("query_id",)).select("query_id", "node", F.round("rank", 6).alias("rank"))


@query("SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM documents WHERE regexp_matches(lower(text), '[a-z0-9]')")
def slugs(t):
    return t.documents.where(F.lower("text").rlike("[a-z0-9]")).select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(twin("atoms", "summaries") + """SELECT id, '- [' || CASE WHEN type = 'decision' THEN 'DECIDED/' || decision_status ELSE upper(type) END || '] ' || text || CASE WHEN source_ref IS NOT NULL AND source_kind <> 'commit' THEN ' _(' || source_ref || ')_' ELSE '' END AS line FROM atoms JOIN summaries ON atom_id = id AND resolution = 50""")
def atom_lines(t):
    rows = lifted(t, "atoms").join(lifted(t, "summaries").where("resolution = 50").select(F.col("atom_id").alias("id"), "text"), "id")
    return rows.select("id", X.rendered_line(F.col("type"), F.col("decision_status"), F.col("text"), F.col("source_ref"), F.col("source_kind"), F.lit("none")).alias("line"))


@query(twin("atoms", "vectors") + "SELECT id, CASE WHEN vector IS NULL THEN -1.0 ELSE round(list_cosine_similarity(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) END AS relevance FROM atoms LEFT JOIN vectors ON atom_id = id AND model = 'm'")
def similarity_for(t):
    q = list(t.embeddings.where("vec_id = 0").first()["embedding"])
    own = lifted(t, "vectors").where("model = 'm'").select(F.col("atom_id").alias("id"), "vector")
    return retrieval.similarity_for(lifted(t, "atoms").select("id"), own, q, ident="id", vector="vector").select("id", F.round("relevance", 6).alias("relevance"))
