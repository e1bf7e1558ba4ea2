"""Health of a store: 22 checks, each a row of name, severity (ok, warn, fail) and summary.

A check that lacks what it judges is a failure, never ok. Checks are one-row aggregates, so the whole report is one
plan whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guard
from ..model import EPISODIC_EVENTS, HOOK_EVENTS
from . import planning, temporal

# fixed values
EXPECTED_SCHEMA_VERSION = 7
DAY = 86_400
HEARTBEAT_SECONDS = IDLE_SECONDS = 7 * DAY
DRIFT_FAIL_COMMITS, EDGELESS_FAIL_ATOMS, EMPTY_FAIL_RATIO = 20, 20, 0.8
MIN_SCORED_TURNS, SILENCE_WARN_RATIO, NEAR_MISS_MARGIN, NEVER_GATES_RATIO = 20, 0.7, 0.05, 0.02
BACKLOG_WARN, COVERAGE_OK = 25, 0.6

Tables = dict[str, DataFrame]


def said(*parts) -> Column:
    """Parts, columns or words, as one text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column) else F.lit(p) for p in parts])


def row(df: DataFrame, severity: Column, summary: Column) -> DataFrame:
    return df.select(F.coalesce(severity, F.lit("fail")).alias("severity"), summary.alias("summary"))


def share(part: str, whole: str) -> Column:
    return F.format_string("%.0f%%", F.col(part) / F.greatest(F.col(whole), F.lit(1)) * 100)


def n(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(F.coalesce(condition, F.lit(False)))


def has_predicate() -> Column:
    return F.coalesce(F.col("liveness_kind"), F.lit("none")) != "none"


def nothing_returned() -> Column:
    return F.col("atoms_returned").isNull() | (F.size("atoms_returned") == 0)


def schema_version(t: Tables, now: int) -> DataFrame:
    v = t["schema_version"].agg(F.max("version").alias("v"))
    return row(v, F.when(F.col("v") == EXPECTED_SCHEMA_VERSION, "ok").when(F.col("v").isNotNull(), "warn"), F.when(F.col("v") == EXPECTED_SCHEMA_VERSION, said("v", F.col("v"))).otherwise(said("store at v", F.col("v"), f", expected v{EXPECTED_SCHEMA_VERSION}")))


def integrity(t: Tables, now: int) -> DataFrame:
    """Keys that occur twice and edges without an atom at an end stand for what a database would reject."""
    atoms = t["atoms"].groupBy("id", "valid_from").agg(n().alias("c")).agg(n(F.col("c") > 1).alias("twice"))
    ends = t["edges"].select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    lost = ends.join(t["atoms"].select("id").distinct(), "id", "left_anti").agg(n().alias("lost"))
    one = atoms.crossJoin(lost)
    return row(one, F.when((F.col("twice") == 0) & (F.col("lost") == 0), "ok").otherwise("fail"), F.when((F.col("twice") == 0) & (F.col("lost") == 0), F.lit("keys and edge ends ok")).otherwise(said(F.col("twice"), " repeated key(s), ", F.col("lost"), " edge end(s) without atom")))


def journal(t: Tables, now: int) -> DataFrame:
    """There is no journal: a snapshot is written whole, then named. What can be told is that nothing is from later."""
    late = t["atoms"].agg(n(F.col("asserted_at") > now).alias("late"))
    return row(late, F.when(F.col("late") == 0, "ok").otherwise("warn"), F.when(F.col("late") == 0, F.lit("snapshots whole")).otherwise(said(F.col("late"), " atom(s) asserted in the future")))


def census(t: Tables, now: int) -> DataFrame:
    c = temporal.live(t["atoms"]).agg(n().alias("n"), n(F.col("pinned")).alias("p"))
    return row(c, F.when(F.col("n") == 0, "warn").otherwise("ok"), said(F.col("n"), " live atoms (", F.col("p"), " pinned)"))


def coverage(t: Tables, now: int) -> DataFrame:
    c = temporal.live(t["atoms"]).agg(n().alias("n"), n(has_predicate()).alias("k"))
    return row(c, F.when((F.col("n") == 0) | (F.col("k") / F.col("n") >= COVERAGE_OK), "ok").otherwise("warn"), said(F.col("k"), "/", F.col("n"), " atoms carry a liveness predicate (", share("k", "n"), ")"))


def freshness(t: Tables, now: int) -> DataFrame:
    since = F.coalesce("liveness_last_ok", "asserted_at")
    c = temporal.live(t["atoms"]).where(has_predicate()).agg(n().alias("n"), n(since < now - DAY).alias("stale"), n(F.col("liveness_last_ok").isNull() & (F.col("asserted_at") >= now - DAY)).alias("pending"))
    bad = (F.col("stale") >= 5) & (F.col("stale") / F.col("n") >= 0.2)
    severity = F.when((F.col("stale") == 0) & (F.col("pending") > 0), "warn").when(F.col("stale") == 0, "ok").when(bad, "fail").otherwise("warn")
    text = F.when((F.col("stale") == 0) & (F.col("pending") > 0), said(F.col("pending"), "/", F.col("n"), " predicates not run yet")).when(F.col("stale") == 0, F.lit("no stale atoms")).otherwise(said(F.col("stale"), "/", F.col("n"), " predicates stale (", share("stale", "n"), ")"))
    return row(c, severity, text)


def unverifiable(t: Tables, now: int) -> DataFrame:
    """``ast`` predicates need declarations of the target's language; those of other files cannot be run."""
    from ..sources.files import LANGUAGES

    known = [s for ends, _ in LANGUAGES.values() for s in ends]
    suffix = F.lower(F.regexp_extract(F.coalesce("liveness_target", F.lit("")), r"(\.[^./]*)$", 1))
    c = temporal.live(t["atoms"]).agg(n((F.col("liveness_kind") == "ast") & ~suffix.isin(*known)).alias("n"))
    return row(c, F.when(F.col("n") == 0, "ok").otherwise("warn"), said(F.col("n"), " atom(s) carry a predicate with no runner"))


def embedding_drift(t: Tables, now: int) -> DataFrame:
    live = temporal.live(t["atoms"]).select(F.col("id").alias("atom_id"))
    c = t["atom_vectors"].join(live, "atom_id", "left_semi").agg(n().alias("n"), F.count_distinct("model").alias("m"))
    return row(c, F.when(F.col("m") <= 1, "ok").otherwise("fail"), F.when(F.col("n") == 0, F.lit("no embeddings written yet")).when(F.col("m") == 1, said(F.col("n"), " embeddings, single model")).otherwise(said(F.col("m"), " embedding models present")))


def model_match(t: Tables, now: int) -> DataFrame:
    asked = t["settings"].select(F.col("model").alias("asked")).limit(1)
    c = t["atom_vectors"].agg(F.collect_set("model").alias("models")).crossJoin(asked)
    fits = (F.size("models") == 0) | F.array_contains("models", F.col("asked"))
    return row(c, F.when(fits, "ok").otherwise("fail"), F.when(fits, F.lit("vectors are of the querying model")).otherwise(said("stored embeddings are of ", F.array_join(F.sort_array("models"), ", "), ", queries use ", F.col("asked"))))


def edge_density(t: Tables, now: int) -> DataFrame:
    e = t["edges"].where("valid_to is null and status = 'live'").agg(n().alias("e"), F.count_distinct("kind").alias("k"))
    a = temporal.live(t["atoms"]).agg(n().alias("a"), n(~F.col("source_kind").eqNullSafe(F.lit("commit"))).alias("g"))
    c = e.crossJoin(a)
    severity = F.when((F.col("e") > 0) | (F.col("a") == 0), "ok").when(F.col("g") >= EDGELESS_FAIL_ATOMS, "fail").otherwise("warn")
    return row(c, severity, F.when(F.col("e") > 0, said(F.col("e"), " edges across ", F.col("k"), " kind(s)")).otherwise(said("0 edges across ", F.col("a"), " atoms")))


def ingest_completed(t: Tables, now: int) -> DataFrame:
    c = t["repo_state"].agg(n(F.col("last_indexed_at").isNull()).alias("n"))
    return row(c, F.when(F.col("n") == 0, "ok").otherwise("fail"), F.when(F.col("n") == 0, F.lit("all registered repos ingested")).otherwise(said(F.col("n"), " repo(s) registered but never ingested")))


def ingest_notes(t: Tables, now: int) -> DataFrame:
    c = t["repo_state"].agg(F.coalesce(F.sum("last_atoms_skipped"), F.lit(0)).alias("s"), n(F.col("last_atoms_skipped") > 0).alias("r"))
    return row(c, F.when(F.col("s") == 0, "ok").otherwise("warn"), said("last ingest left ", F.col("s"), " atom(s) skipped across ", F.col("r"), " repo(s)"))


def retrieval_quality(t: Tables, now: int) -> DataFrame:
    gated = F.coalesce("n_suppressed", F.lit(0)) > 0
    c = t["retrieval_log"].agg(n().alias("n"), n(nothing_returned() & ~gated).alias("empty"), n(gated).alias("gated"))
    severity = F.when(F.col("empty") == 0, "ok").when(F.col("empty") / F.col("n") >= EMPTY_FAIL_RATIO, "fail").otherwise("warn")
    text = F.when(F.col("n") == 0, F.lit("no queries logged")).when((F.col("empty") == 0) & (F.col("gated") == 0), said("all ", F.col("n"), " logged queries returned atoms")).when(F.col("empty") == 0, said(F.col("n"), " logged queries, ", F.col("gated"), " silenced by the gate"))
    return row(c, severity, F.coalesce(text, said(F.col("empty"), "/", F.col("n"), " queries returned nothing (", share("empty", "n"), ")")))


def calibration_counts(log: DataFrame) -> DataFrame:
    """n, silenced, gated, near_miss of scored turns, and the latest floor: one row."""
    gated = F.coalesce("n_suppressed", F.lit(0)) > 0
    silent = gated & nothing_returned()
    scored = log.where("top_relevance is not null and min_relevance is not null")
    counts = scored.agg(n().alias("n"), n(silent).alias("silenced"), n(gated).alias("gated"), n(silent & (F.col("top_relevance") >= F.col("min_relevance") - NEAR_MISS_MARGIN)).alias("near_miss"))
    floor = log.where("min_relevance is not null").agg(F.max_by("min_relevance", "id").alias("floor"))
    return counts.crossJoin(floor)


def calibration_verdict() -> Column:
    """insufficient, silent, open or calibrated."""
    return F.when(F.col("n") < MIN_SCORED_TURNS, "insufficient").when(F.col("silenced") / F.col("n") >= SILENCE_WARN_RATIO, "silent").when(F.col("gated") / F.col("n") <= NEVER_GATES_RATIO, "open").otherwise("calibrated")


def calibration(t: Tables, now: int) -> DataFrame:
    c = calibration_counts(t["retrieval_log"]).withColumn("v", calibration_verdict())
    floor = F.format_string("%.2f", "floor")
    text = F.when(F.col("v") == "insufficient", said(F.col("n"), " scored turns, too few to judge")).when(F.col("v") == "silent", said(F.col("silenced"), "/", F.col("n"), " turns fully silenced at floor ", floor)).when(F.col("v") == "open", said("floor ", floor, " dropped nothing in ", F.col("n"), " turns"))
    return row(c, F.when(F.col("v").isin("insufficient", "calibrated"), "ok").otherwise("warn"), F.coalesce(text, said("floor ", floor, " looks calibrated — ", F.col("gated"), "/", F.col("n"), " turns gated, ", F.col("silenced"), " fully silenced")))


def capture_queue(t: Tables, now: int) -> DataFrame:
    c = t["candidates"].agg(n(F.col("status") == "pending").alias("n"))
    return row(c, F.when(F.col("n") >= BACKLOG_WARN, "warn").otherwise("ok"), said(F.col("n"), " captured fact(s) pending review"))


def unconfirmed(t: Tables, now: int) -> DataFrame:
    c = temporal.unconfirmed(t["atoms"], now).agg(n().alias("n"))
    return row(c, F.when(F.col("n") == 0, "ok").otherwise("warn"), said(F.col("n"), " fact(s) past their reconfirmation horizon"))


def guard_store(t: Tables, now: int) -> DataFrame:
    live = temporal.live(t["atoms"])
    texts = live.select("id", F.col("topic_key").alias("text")).unionByName(t["atom_summaries"].join(live.select(F.col("id").alias("atom_id")), "atom_id", "left_semi").select(F.col("atom_id").alias("id"), "text"))
    c = texts.withColumn("f", F.size(guard.findings(F.col("text")))).where("f > 0").agg(F.count_distinct("id").alias("n"))
    return row(c, F.when(F.col("n") == 0, "ok").otherwise("warn"), said(F.col("n"), " live atom(s) hold secrets or personal data"))


def activity(t: Tables, now: int) -> DataFrame:
    c = t["retrieval_log"].agg(n(F.col("ts") >= now - IDLE_SECONDS).alias("n"))
    return row(c, F.when(F.col("n") > 0, "ok").otherwise("warn"), said(F.col("n"), " retrieval(s) logged in last 7 days"))


def heartbeat(t: Tables, now: int) -> DataFrame:
    seen = F.unix_timestamp(F.expr("try_to_timestamp(last_invoked_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    recent = F.coalesce(seen >= now - HEARTBEAT_SECONDS, F.lit(False)) & F.col("event").isin(*HOOK_EVENTS)
    c = t["hook_heartbeat"].agg(F.collect_set(F.when(recent, F.col("event"))).alias("seen"), n(seen.isNotNull()).alias("ever"))
    unseen = F.array_except(F.array(*[F.lit(e) for e in HOOK_EVENTS if e not in EPISODIC_EVENTS]), F.col("seen"))
    return row(c, F.when(F.size(unseen) == 0, "ok").otherwise("warn"), F.when(F.size(unseen) == 0, F.lit("all periodic hook events invoked within 7d")).when(F.col("ever") == 0, F.lit("hooks never invoked")).otherwise(said(F.array_join(unseen, ", "), " not seen in 7d")))


def repo_freshness(t: Tables, now: int) -> DataFrame:
    drifts = planning.drift(t["repo_state"], t["probes"], t.get("dirty"))
    c = drifts.agg(n().alias("n"), n(F.col("description").startswith("root no longer")).alias("gone"), n(F.col("drifted")).alias("stale"), F.coalesce(F.sum(F.when(F.col("drifted"), F.col("behind"))), F.lit(0)).alias("behind"), n(F.col("drifted") & F.col("unknown_base")).alias("unknown"), n(F.col("drifted") & F.col("never_indexed")).alias("never"))
    severity = F.when(F.col("n") == 0, "warn").when(F.col("gone") > 0, "fail").when(F.col("stale") == 0, "ok").when((F.col("unknown") > 0) | (F.col("behind") >= DRIFT_FAIL_COMMITS), "fail").otherwise("warn")
    text = F.when(F.col("n") == 0, F.lit("no repos registered")).when(F.col("gone") > 0, said(F.col("gone"), "/", F.col("n"), " registered root(s) no longer exist")).when(F.col("stale") == 0, said(F.col("n"), " repo(s) current with HEAD")).when(F.col("behind") > 0, said("index is ", F.col("behind"), " commit(s) behind HEAD across ", F.col("stale"), "/", F.col("n"), " repo(s)")).when(F.col("unknown") > 0, said(F.col("unknown"), "/", F.col("n"), " repo(s) indexed against a sha git cannot resolve"))
    return row(c, severity, F.coalesce(text, said("drift unmeasurable — ", F.col("never"), "/", F.col("n"), " repo(s) never indexed")))


def git_hooks(t: Tables, now: int) -> DataFrame:
    """hooks (root, managed, lists_this): what the hook files of the roots say."""
    c = t["hooks"].agg(n().alias("n"), n(~(F.col("managed") & F.col("lists_this"))).alias("bad"))
    return row(c, F.when(F.col("bad") == 0, "ok").otherwise("warn"), F.when(F.col("bad") == 0, said("managed sync hook in ", F.col("n"), " root(s)")).otherwise(said(F.col("bad"), " git-hook problem(s)")))


def handoff_dir(t: Tables, now: int) -> DataFrame:
    """handoffs (path, modified_at): hand-over files."""
    c = t["handoffs"].agg(n().alias("n"), F.max("modified_at").alias("m"))
    return row(c, F.when(F.col("n") == 0, "warn").otherwise("ok"), F.when(F.col("n") == 0, F.lit("no handoffs yet")).otherwise(said(F.col("n"), " handoff(s), latest ", F.format_string("%.1f", (F.lit(now) - F.col("m")) / 3600), "h ago")))


#: name -> (check, tables that it needs), in the order of the report.
CHECKS: dict[str, tuple[Callable[[Tables, int], DataFrame], tuple[str, ...]]] = {
    "schema.version": (schema_version, ("schema_version",)), "db.integrity": (integrity, ("atoms", "edges")), "db.journal": (journal, ("atoms",)), "atoms.census": (census, ("atoms",)),
    "liveness.coverage": (coverage, ("atoms",)), "liveness.freshness": (freshness, ("atoms",)), "liveness.unverifiable": (unverifiable, ("atoms",)), "embeddings.drift": (embedding_drift, ("atoms", "atom_vectors")),
    "embeddings.model_match": (model_match, ("atom_vectors", "settings")), "edges.density": (edge_density, ("atoms", "edges")), "ingest.completed": (ingest_completed, ("repo_state",)), "ingest.notes": (ingest_notes, ("repo_state",)),
    "retrieval.quality": (retrieval_quality, ("retrieval_log",)), "retrieval.calibration": (calibration, ("retrieval_log",)), "capture.queue": (capture_queue, ("candidates",)), "capture.unconfirmed": (unconfirmed, ("atoms",)),
    "guard.store": (guard_store, ("atoms", "atom_summaries")), "retrieval.activity": (activity, ("retrieval_log",)), "hooks.heartbeat": (heartbeat, ("hook_heartbeat",)), "repo.freshness": (repo_freshness, ("repo_state", "probes")),
    "hooks.git": (git_hooks, ("hooks",)), "handoff.dir": (handoff_dir, ("handoffs",)),
}


def report(spark: SparkSession, tables: Tables, now: int, quick: bool = False) -> DataFrame:
    """place, name, severity, summary of every check; ``quick`` leaves the integrity scan out."""
    out = None
    for place, (name, (check, needs)) in enumerate(CHECKS.items()):
        if quick and name == "db.integrity":
            continue
        lost = [t for t in needs if t not in tables]
        found = spark.range(1).select(F.lit("fail").alias("severity"), F.lit(f"check COULD NOT RUN: no {', '.join(lost)}").alias("summary")) if lost else check(tables, now)
        found = found.select(F.lit(place).alias("place"), F.lit(name).alias("name"), "severity", "summary")
        out = found if out is None else out.unionByName(found)
    return out


def report_counts(findings: DataFrame) -> DataFrame:
    """n_fail, n_warn, n_ok of a report."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("fail", "warn", "ok")])
