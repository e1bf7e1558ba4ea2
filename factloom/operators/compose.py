"""Composites: retrieve, route, why, discover, hand over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import RETRIEVAL_LOG, ROUTES, TURN_TOKENS
from . import discovery, graph, liveness, retrieval, temporal
from .stage import cut



def source_path() -> F.Column:
    """Path of an atom's source: none for commits and empty ones, without a line number."""
    path = F.regexp_replace("source_ref", r"(?<=.):\d+$", "")
    return F.when(F.col("source_kind").eqNullSafe(F.lit("commit")) | (F.col("source_ref") == ""), None).otherwise(path)


def symbol_name(topic: str = "topic_key") -> F.Column:
    """Name of a ``symbol:path:name`` topic; null for others and for empty names."""
    name = F.element_at(F.split(topic, ":"), -1)
    return F.when(F.col(topic).startswith("symbol:") & (name != ""), name)


# fixed values
MODULE_PREFIX, SYMBOL_PREFIX = "module:", "symbol:"
TEST_FOLDERS = ("tests/", "test/", "__tests__/", "spec/")
TEST_STARTS = ("test_", "Test")
TEST_ENDS = ("_test.py", "_test.go", ".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js")


def scaffolding(topic: F.Column) -> F.Column:
    """Topics that serve retrieval rather than a reader: modules, and symbols of test files."""
    path = F.regexp_extract(topic, "^symbol:(.*):[^:]*$", 1)
    name = F.element_at(F.split(path, "/"), -1)
    tested = F.lit(False)
    for folder in TEST_FOLDERS:
        tested = tested | F.lower(path).contains(folder)
    for start in TEST_STARTS:
        tested = tested | name.startswith(start)
    for end in TEST_ENDS:
        tested = tested | name.endswith(end)
    return F.coalesce(topic.startswith(MODULE_PREFIX) | (topic.startswith(SYMBOL_PREFIX) & (path != "") & tested), F.lit(False))


HITS = ["id", "topic_key", "score", "relevance", "depth", "trail", "state", "is_live"]


def retrieve(atoms: DataFrame, edges: DataFrame, vectors: DataFrame, query: list[float], *, model: str, files: tuple[str, ...] = (), seed_k: int = 10, top_n: int = 20, now: int, half_life_days: float = 90.0, drill: bool = True, hot: int = 3, decay: bool = True, sources: DataFrame | None = None, symbols: DataFrame | None = None, fresh: int = 3600, live_only: bool = True) -> DataFrame:
    """The best atoms for a query: columns ``HITS``.

    Seeds are the nearest atoms of the same model and those of the files at hand. Rank is Personalized
    PageRank from them; the children of the hottest modules are drilled into; scores decay by age. Where
    ``sources`` (path, text) are given, hits are verified against them best first: one that fails gives its
    place to the next. ``state`` is none, trusted, verified, unverifiable or unconfirmed; relevance is the
    atom's own cosine, -1 if unknown. Without seeds the most recent atoms come, with score 0. ``live_only``
    hides closed and archived atoms that an edge still reaches.
    """
    spark = atoms.sparkSession
    live = temporal.live(atoms)
    q = spark.createDataFrame([("q", [float(x) for x in query])], "query_id string, vector array<double>")
    own = vectors.where(F.col("model") == model).select(F.col("atom_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    near = retrieval.top_k(own.join(live.select("id"), "id", "left_semi"), q, seed_k, ident="id", vector="vector").select(F.col("id").alias("node"), F.col("cosine").alias("score"))
    exact = live.where(source_path().isin(*files) if files else F.lit(False)).select(F.col("id").alias("node"))
    seeds = cut(retrieval.seeds(near, exact))
    if seeds.isEmpty():
        recent = live.orderBy(F.desc("asserted_at"), "id").limit(top_n)
        return recent.select("id", "topic_key", F.lit(0.0).alias("score"), F.lit(-1.0).alias("relevance"), F.lit(0).alias("depth"), F.lit("seed").alias("trail"), F.lit(liveness.NONE).alias("state"), F.lit(True).alias("is_live"))
    standing = edges.where("valid_to is null and status = 'live'")
    adj = cut(graph.adjacency(standing))
    rank = cut(graph.pagerank(adj, seeds))
    if drill:
        modules = atoms.where("tier = 'module'").select(F.col("id").alias("node"))
        children = standing.where("kind = 'ROLLS_UP'").select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst"))
        rank = graph.drilled(adj, rank, modules, children, seeds, top=hot)
    paths = graph.provenance(adj, seeds)
    scored = (atoms if not live_only else live).where(~F.col("archived")).join(rank.withColumnRenamed("node", "id"), "id")
    age_from = F.coalesce("liveness_last_ok", "valid_from", "asserted_at")
    score = temporal.decayed(F.col("rank"), F.col("confidence"), age_from, now, half_life_days) if decay else F.col("rank")
    scored = cut(scored.withColumn("score", score).where("score > 0"))
    best = verified_best(scored, top_n, sources, symbols, now=now, fresh=fresh)
    relevance = retrieval.similarity_for(best.select("id"), own, query, ident="id", vector="vector")
    joined = best.join(relevance, "id").join(paths.withColumnRenamed("node", "id"), "id", "left")
    depth = F.coalesce("depth", F.lit(0))
    return joined.select("id", "topic_key", "score", "relevance", depth.alias("depth"), graph.trail(depth, F.col("via")).alias("trail"), "state", F.col("valid_to").isNull().alias("is_live"))


def verified_best(scored: DataFrame, top: int, sources: DataFrame | None, symbols: DataFrame | None, *, now: int, fresh: int = 3600) -> DataFrame:
    """The best ``top`` of scored atoms that do not fail, with ``state``; only as many are checked as are needed."""
    order = (F.desc("score"), F.desc("id"))
    if sources is None:
        return liveness.with_horizon(scored.orderBy(*order).limit(top).withColumn("state", F.lit(liveness.NONE)), now)
    total, taken = scored.count(), 2 * top
    while True:
        state = cut(liveness.at_emission(scored.orderBy(*order).limit(taken), sources, symbols, now=now, fresh=fresh))
        kept = state.where(F.col("state") != liveness.FAILED)
        if taken >= total or kept.count() >= top:
            return liveness.with_horizon(kept.orderBy(*order).limit(top), now)
        taken *= 4


def routed(hits: DataFrame, atoms: DataFrame, summaries: DataFrame, prompt_class: str, *, floor: float = 0.0, cap: int = TURN_TOKENS) -> DataFrame:
    """Hits that pass the gate, as many as the prompt's class takes, with the line that shows each, up to the
    token budget: id, text, line, tokens, running, relevance, score, trail, state.

    Tokens are those of the whole line; the first line that would exceed ``cap`` ends the list.
    """
    n, resolution = ROUTES[prompt_class]
    first = hits.orderBy(F.desc("score"), F.desc("id")).limit(n)
    kept = retrieval.gated(first.withColumn("scaffolding", scaffolding(F.col("topic_key"))), floor).where("verdict = 'kept'")
    texts = summaries.where(F.col("resolution") == resolution).select(F.col("atom_id").alias("id"), "text")
    about = atoms.select("id", "type", "decision_status", "source_ref", "source_kind")
    shown = kept.join(about, "id").join(texts, "id", "left").withColumn("text", F.coalesce("text", "topic_key"))
    state = F.col("state") if "state" in hits.columns else F.lit(None).cast("string")
    line = X.rendered_line(F.col("type"), F.col("decision_status"), F.col("text"), F.col("source_ref"), F.col("source_kind"), state)
    costed = shown.withColumns({"line": line, "__neg": -F.col("score")}).withColumn("tokens", X.token_estimate(F.col("line")))
    place = Window.partitionBy().orderBy("__neg", F.desc("id"))  # seven rows at most
    return retrieval.within_budget(costed.withColumn("__at", F.row_number().over(place)), order=["__at"], tokens="tokens", cap=cap).drop("__neg", "__at", "scaffolding", "verdict")


def route(prompt: str, atoms: DataFrame, edges: DataFrame, vectors: DataFrame, summaries: DataFrame, embed, *, model: str, now: int, floor: float = 0.0, files: tuple[str, ...] = (), **how) -> tuple[DataFrame, DataFrame]:
    """Lines for a prompt, and its log row: classify, retrieve, gate, cut to the budget."""
    spark = atoms.sparkSession
    one = spark.createDataFrame([(prompt,)], "text string")
    kind = one.select(X.prompt_class(F.col("text"))).first()[0]
    hits = cut(retrieve(atoms, edges, vectors, embed(prompt), model=model, files=files, top_n=ROUTES[kind][0], now=now, **how))
    lines = cut(routed(hits, atoms, summaries, kind, floor=floor))
    verdict = retrieval.gate_summary(retrieval.gated(hits.withColumn("scaffolding", scaffolding(F.col("topic_key"))), floor)).first()
    shown = lines.orderBy(F.desc("score"), F.desc("id")).collect()  # seven rows at most
    row = {"id": None, "ts": now, "session_id": None, "query": prompt[:500], "classified_as": kind, "atoms_returned": [r["id"] for r in shown], "injected_tokens": sum(r["tokens"] for r in shown), "user_feedback": None, "relevances": [round(r["relevance"], 4) for r in shown], "top_relevance": -1.0 if verdict["top_relevance"] is None else verdict["top_relevance"], "n_suppressed": verdict["n_suppressed"], "min_relevance": float(floor)}
    return lines, spark.createDataFrame([row], RETRIEVAL_LOG)


def query_facts(atoms: DataFrame, edges: DataFrame, vectors: DataFrame, summaries: DataFrame, query: list[float], *, floor: float = 0.0, resolution: int = 50, **how) -> DataFrame:
    """The hits of a query that pass the gate, with their summary: another visibility than ``routed`` - no
    token budget, unverifiable and unconfirmed facts marked by their state."""
    hits = retrieve(atoms, edges, vectors, query, **how)
    kept = retrieval.gated(hits.withColumn("scaffolding", scaffolding(F.col("topic_key"))), floor).where("verdict = 'kept'").drop("verdict", "scaffolding")
    texts = summaries.where(F.col("resolution") == resolution).select(F.col("atom_id").alias("id"), F.col("text").alias("summary"))
    return kept.join(atoms.select("id", "type", "decision_status", "source_ref"), "id").join(texts, "id", "left").orderBy(F.desc("score"), F.desc("id"))


def relevance_tops(queries: DataFrame, atoms: DataFrame, edges: DataFrame, vectors: DataFrame, *, model: str, top_n: int = 3, seed_k: int = 10, now: int, half_life_days: float = 90.0) -> DataFrame:
    """kind, query_id, value: the best known relevance among each query's ``top_n`` hits, for a whole batch of
    queries (kind, query_id, vector) in one iteration of rank by (query, node)."""
    live = temporal.live(atoms)
    own = vectors.where(F.col("model") == model).select(F.col("atom_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    near = cut(retrieval.top_k(own.join(live.select("id"), "id", "left_semi"), queries, seed_k, ident="id", vector="vector").where("cosine > 0"))
    whole = near.groupBy("query_id").agg(F.sum("cosine").alias("s"))
    seeds = near.join(whole, "query_id").select("query_id", F.col("id").alias("node"), (F.col("cosine") / F.col("s")).alias("p"))
    adj = cut(graph.adjacency(edges.where("valid_to is null and status = 'live'")))
    rank = graph.pagerank(adj, seeds, per=("query_id",))
    aged = live.select("id", "topic_key", "confidence", F.coalesce("liveness_last_ok", "valid_from", "asserted_at").alias("since"))
    scored = rank.withColumnRenamed("node", "id").join(aged, "id").withColumn("score", temporal.decayed(F.col("rank"), F.col("confidence"), F.col("since"), now, half_life_days)).where("score > 0")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    best = scored.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top_n)
    asked = queries.select("kind", "query_id", F.col("vector").alias("asked"))
    hits = best.join(own, "id", "left").join(asked, "query_id").withColumn("relevance", F.coalesce(retrieval.cosine(F.col("vector"), F.col("asked")), F.lit(-1.0)))
    return retrieval.query_tops(hits)


#: Word salads that no store has an answer to: what they score is what relevance is worth nothing.
NONSENSE = (
    "green parliament of humming spoons", "qworl flibber zantic mup", "velvet gravity invoices a teapot", "seven lanterns boil the alphabet",
    "moss telegram under a square opera", "glorp the sideways mandolin tax", "umbrella thunder pickles tuesday", "paper volcano sings to accountants",
    "a drowsy compass knits plutonium", "brass pigeons negotiate with soup", "unripe calendar wrestling fog", "marble whisper fourteen bicycles",
)


def derived_floor(log: DataFrame, atoms: DataFrame, edges: DataFrame, vectors: DataFrame, embed, *, model: str, now: int, limit: int = 200, least: int = 20) -> DataFrame:
    """The relevance floor from logged prompts against nonsense: status, floor and the two percentiles; refuses
    under ``least`` distinct prompts or vectors, and where the two do not separate."""
    spark = atoms.sparkSession
    asked = genuine_queries(log, limit).collect()  # ``limit`` rows at most
    rows = [("genuine", f"g{i}", embed(r["query"])) for i, r in enumerate(asked)] + [("nonsense", f"n{i}", embed(t)) for i, t in enumerate(NONSENSE)]
    queries = spark.createDataFrame(rows, "kind string, query_id string, vector array<double>")
    embedded = vectors.where(F.col("model") == model).select("atom_id").distinct().count()
    tops = relevance_tops(queries, atoms, edges, vectors, model=model, now=now)
    return retrieval.calibrated(tops, least=least, embedded=embedded, least_embedded=least)


def genuine_queries(log: DataFrame, limit: int) -> DataFrame:
    """query, last_seen: distinct logged prompts of more than two characters, the most recent first."""
    return log.where(F.length(F.trim("query")) > 2).groupBy("query").agg(F.max("ts").alias("last_seen")).orderBy(F.desc("last_seen"), "query").limit(limit)


def why(atoms: DataFrame, edges: DataFrame, evidence: DataFrame, ident: str) -> DataFrame:
    """Edges of an atom with the atom at the other end and the evidence: kind, direction, other, topic, payloads."""
    out = edges.where((F.col("src_id") == ident) | (F.col("dst_id") == ident))
    forward = F.col("src_id") == ident
    sides = out.select("id", "kind", "weight", F.when(forward, "out").otherwise("in").alias("direction"), F.when(forward, F.col("dst_id")).otherwise(F.col("src_id")).alias("other"))
    proofs = evidence.groupBy(F.col("edge_id").alias("id")).agg(F.sort_array(F.collect_set("payload")).alias("payloads"))
    names = atoms.select(F.col("id").alias("other"), "topic_key")
    return sides.join(names, "other", "left").join(proofs, "id", "left").orderBy(F.desc("weight"), "id")


def list_edges(edges: DataFrame, ident: str | None = None, kind: str | None = None, status: str = "live", live_only: bool = True, limit: int = 200) -> DataFrame:
    rows = edges.where(F.col("status") == status)
    rows = rows.where("valid_to is null") if live_only else rows
    rows = rows.where((F.col("src_id") == ident) | (F.col("dst_id") == ident)) if ident else rows
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.orderBy(F.desc("weight"), F.desc("id")).limit(limit)


def closed_edges(edges: DataFrame, ids: DataFrame, now: int, reject: bool = False) -> DataFrame:
    """Edges of the ids (id) expired at ``now``, or rejected."""
    hit = edges.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    gone = F.coalesce("__hit", F.lit(False))
    if reject:
        return hit.withColumn("status", F.when(gone, "rejected").otherwise(F.col("status"))).drop("__hit")
    return hit.withColumn("valid_to", F.when(gone, F.coalesce("valid_to", F.lit(now))).otherwise(F.col("valid_to"))).drop("__hit")


def flagged(atoms: DataFrame, ids: DataFrame, flag: str, on: bool = True) -> DataFrame:
    """archived or pinned set on the named atoms."""
    hit = atoms.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return hit.withColumn(flag, F.when(F.coalesce("__hit", F.lit(False)), F.lit(on)).otherwise(F.col(flag))).drop("__hit")


def with_evidence(evidence: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """Evidence with new rows (edge_id, kind, payload, created_at) of edges that exist; a fact stated twice is one."""
    known = added.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    both = evidence.unionByName(known.select(*evidence.columns))
    return both.groupBy("edge_id", "kind", "payload").agg(F.min("created_at").alias("created_at")).select(*evidence.columns)


def blocks(atoms: DataFrame, decision: str, prefixes: list[str]) -> DataFrame:
    """BLOCKS edges (0.9) from a decision to every live atom whose source starts with a prefix, and the prefix
    as ``evidence``."""
    spark = atoms.sparkSession
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")  # as given by the caller
    under = temporal.live(atoms).where(F.col("id") != decision).join(F.broadcast(table), F.col("source_ref").startswith(F.col("prefix")))
    return under.groupBy(F.col("id").alias("dst_id")).agg(F.min("prefix").alias("evidence")).select(F.lit(decision).alias("src_id"), "dst_id", F.lit("BLOCKS").alias("kind"), F.lit(True).alias("directed"), F.lit(0.9).alias("weight"), "evidence")


def mirrors_of(atoms: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """id of live atoms that a MIRRORS edge touches and whose topic holds the symbol: the two ends are joined one
    by one, so that no row meets all others."""
    standing = edges.where("kind = 'MIRRORS' and valid_to is null")
    ends = standing.select(F.col("src_id").alias("id")).unionByName(standing.select(F.col("dst_id").alias("id"))).distinct()
    return temporal.live(atoms).where(F.col("topic_key").contains(symbol)).join(ends, "id", "left_semi").select("id", "topic_key")


def atom_texts(atoms: DataFrame, summaries: DataFrame) -> DataFrame:
    """Live atoms with all their summaries joined in order of resolution ("" if none): id, path, repo_id, symbol, text."""
    joined = summaries.groupBy(F.col("atom_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resolution", "text"))), lambda x: x["text"]), " ").alias("text"))
    live = temporal.live(atoms).select("id", source_path().alias("path"), "repo_id", symbol_name().alias("symbol"))
    return live.join(joined, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


# fixed value
PATH_TOKEN = r"[\w./\\-]*\w\.\w{1,8}\b"


def discovered(atoms: DataFrame, summaries: DataFrame, changes: DataFrame, most: int = 5000, rules: tuple[str, ...] = ("references", "mirrors", "co_changed")) -> DataFrame:
    """Edges of the rules with their evidence, up to a budget in order of emission: references by atom,
    mirrors by symbol, then co-changes, most frequent first. A second run over the same input finds the same."""
    every = atom_texts(atoms, summaries)
    parts = []
    if "references" in rules:
        mentions = every.where("text <> ''").select("id", "path", "repo_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATH_TOKEN), F.lit(0)))).alias("token"))
        refs = discovery.path_references(mentions, every.where("path is not null"))
        parts.append(refs.select(F.lit(0).alias("rule"), F.array(F.col("src"), F.col("token"), F.col("dst")).alias("at"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("REFERENCES").alias("kind"), F.lit(0.6).alias("weight"), F.col("token").alias("evidence")))
    if "mirrors" in rules:
        twins = discovery.mirrors(every.where("symbol is not null"), ident="id", symbol="symbol", repo="repo_id", stop=discovery.COMMON_SYMBOLS)
        parts.append(twins.select(F.lit(1), F.array("symbol", "a", "b"), "a", "b", F.lit("MIRRORS"), F.col("weight").cast("double"), "symbol"))
    if "co_changed" in rules:
        pairs = discovery.co_changes(changes, commit="commit_id", file="path")
        first = Window.partitionBy("path").orderBy("id")
        by_path = every.where("path is not null").withColumn("nth", F.row_number().over(first)).where("nth <= 6").select("path", "id")
        left, right = by_path.select(F.col("path").alias("a"), F.col("id").alias("x")), by_path.select(F.col("path").alias("b"), F.col("id").alias("y"))
        together = pairs.join(left, "a").join(right, "b").where("x <> y")
        order = F.array(F.lpad((1_000_000_000 - F.col("n")).cast("string"), 10, "0"), "a", "b", "x", "y")
        note = F.concat("a", F.lit(" + "), "b", F.lit(" x"), F.col("n").cast("string"))
        parts.append(together.select(F.lit(2), order, F.least("x", "y"), F.greatest("x", "y"), F.lit("CO_CHANGED"), F.col("weight").cast("double"), note))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.orderBy("rule", "at").limit(most).groupBy("src_id", "dst_id", "kind").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_set("evidence")).alias("evidence"))


def handed_over(log: DataFrame, since: int, most: int = 50) -> DataFrame:
    """Atoms returned since a time, the most recent prompt's first, each at its first appearance: atom_id."""
    seen = log.where(F.col("ts") >= since).select("id", "ts", F.posexplode("atoms_returned").alias("at", "atom_id"))
    place = F.struct((-F.col("ts")).alias("t"), F.col("id").alias("i"), F.col("at").alias("a"))
    return seen.groupBy("atom_id").agg(F.min(place).alias("first")).orderBy("first").limit(most).select("atom_id")


def drafted(atoms: DataFrame, since: int, most: int = 30) -> DataFrame:
    """Atoms written since a time, newest first: id, type, topic_key."""
    return atoms.where((F.col("created_at") >= since) & ~F.col("archived")).orderBy(F.desc("created_at"), "id").limit(most).select("id", "type", "topic_key")


def logged(prompts: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieval log rows (id, ts, query, classified_as, atoms_returned, relevances, top_relevance)."""
    lists = hits.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "relevance"))).alias("r"))
    joined = prompts.join(lists, prompts["id"] == lists["prompt_id"], "left")
    return joined.select("id", "ts", F.col("text").alias("query"), X.prompt_class(F.col("text")).alias("classified_as"), F.coalesce(F.col("r.id"), F.array().cast("array<string>")).alias("atoms_returned"), F.col("r.relevance").alias("relevances"), F.array_max("r.relevance").alias("top_relevance"))
