"""From files and logs to atoms: adapters in order, a budget of time, assertion, summaries, edges, reaping.

An adapter turns an ``Input`` into facts or atoms. One that fails is reported and does not stop the others; one
that the budget no longer reaches is deferred, and then the state keeps its last indexed commit, so that the next run
sees the same changes again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import ATOMS, EDGES, SUMMARIES
from ..operators import compose, discovery, merge, temporal
from ..operators.stage import cut
from . import files as R

#: Share, owners and directories of the ownership adapter (fixed values).
OWNER_SHARE, OWNERS, DIRECTORIES = 0.25, 3, 40


@dataclass
class Input:
    """What a run reads. files (path, text); commits (sha, ts, author, subject, body) and commit_files (sha, path) or
    None without version control; changed and deleted (path) or None where unknown; tracked (path)."""

    files: DataFrame
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    changed: DataFrame | None = None
    deleted: DataFrame | None = None
    base: str | None = None
    repo_id: str = "repo"
    workspace_id: str = "default"
    now: int = 0

    def seen(self) -> DataFrame:
        return R.only_changed(self.files, self.changed) if self.changed is not None else self.files


@dataclass
class Result:
    """Outcome of an adapter: rows (columns of ``atoms_of``) unless it was skipped or failed."""

    name: str
    rows: DataFrame | None = None
    skipped: str | None = None
    error: str | None = None
    deferred: bool = False
    notes: list[str] = field(default_factory=list)

    def status(self) -> str:
        return f"err: {self.error}" if self.error else f"skip: {self.skipped}" if self.skipped else "ok"


def atoms_of(facts: DataFrame, source: Input, *, tier: str = "symbol") -> DataFrame:
    """Atoms with their three texts (short, claim, long) from facts; skipped ones left out."""
    rows = facts.where(F.col("kind") != R.SKIPPED)
    have = set(facts.columns)
    get = lambda name, default=None: F.col(name) if name in have else F.lit(default)
    path = get("path")
    is_symbol = F.col("topic").startswith("symbol:")
    live = get("live", "none")
    given = {
        "id": X.content_id(F.col("kind"), F.col("topic"), F.col("claim")), "type": F.col("kind"), "topic_key": F.col("topic"), "tier": F.lit(tier), "source_kind": get("source", "commit"),
        "source_ref": F.coalesce(get("source_ref"), F.when(is_symbol, F.concat(path, F.lit(":0"))).otherwise(path)), "decision_status": get("decision_status"), "decision_class": get("decision_class"),
        "valid_from": F.coalesce(get("valid_from"), F.lit(source.now)), "asserted_at": F.lit(source.now), "created_at": F.lit(source.now), "updated_at": F.lit(source.now),
        "liveness_kind": live, "liveness_target": F.when(live != "none", path), "liveness_pattern": F.when(live != "none", get("pattern")), "confidence": F.coalesce(get("confidence"), F.lit(1.0)),
        "repo_id": F.lit(source.repo_id), "workspace_id": F.lit(source.workspace_id), "pinned": F.lit(False), "archived": F.lit(False), "valid_in_refs": F.array(),
    }
    texts = [F.col("short"), F.col("claim"), F.when(get("long", "") != "", get("long", "")).otherwise(F.col("claim")).alias("long")]
    order = F.struct(F.coalesce(path.cast("string"), F.lit("")), get("nth", 0).cast("int")).alias("__order")
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ATOMS], *texts, order)


def _files(parse: Callable, cap: str, suffixes: tuple[str, ...] = ()) -> Callable[[Input], DataFrame]:
    def run(source: Input) -> DataFrame:
        rows = source.seen()
        if suffixes:
            rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes))
        facts = R.parsed(rows, parse)
        return atoms_of(R.capped(facts.where(F.col("kind") != R.SKIPPED), R.CAPS[cap]) if cap else facts, source)

    return run


def _manifests(source: Input) -> DataFrame:
    rows = source.seen().where(F.col("path").isin(*R.PARSERS))  # those of the root only
    return atoms_of(R.capped(R.parsed(rows, R.manifest).where(F.col("kind") != R.SKIPPED), R.CAPS["manifest"]), source)


def _commits(source: Input) -> DataFrame:
    if source.commits is None:
        raise LookupError("not a git repository")
    return atoms_of(R.commits(source.commits, base=source.base).withColumn("source", F.lit("commit")), source)


def _modules(source: Input) -> DataFrame:
    rows = R.modules(source.seen())
    name = F.col("module")
    facts = rows.select(F.lit("glossary").alias("kind"), F.concat(F.lit("module:"), name).alias("topic"), F.concat(F.lit("module "), name).alias("short"), F.concat(F.lit("Source module `"), name, F.lit("/` — a top-level subsystem of the repo.")).alias("claim"), F.lit("manual").alias("source"), name.alias("source_ref"))
    return atoms_of(facts, source, tier="module")


def _owners(source: Input) -> DataFrame:
    if source.commits is None or source.commit_files is None:
        raise LookupError("not a git repository")
    touched = source.commit_files.where(F.col("path").contains("/")).select("sha", F.split("path", "/")[0].alias("directory")).distinct()
    touched = touched.where(~F.col("directory").startswith(".") & ~F.col("directory").isin(*R.NEVER_MODULES, "node_modules"))
    first = touched.select("directory").distinct().orderBy("directory").limit(DIRECTORIES)
    rows = touched.join(F.broadcast(first), "directory", "left_semi").join(source.commits.select("sha", "author", "ts"), "sha")
    found = discovery.owners(rows, directory="directory", author="author", at="ts", least=OWNER_SHARE, most=OWNERS)
    percent, total = F.concat(F.bround(F.col("share") * 100).cast("int").cast("string"), F.lit("%")), F.bround(F.col("n") / F.col("share")).cast("int").cast("string")
    claim = F.concat("author", F.lit(" is a principal author of `"), "directory", F.lit("/` — "), F.col("n").cast("string"), F.lit(" of the last "), total, F.lit(" commits there ("), percent, F.lit(")."))
    long = F.concat("author", F.lit(" authored "), F.col("n").cast("string"), F.lit(" commits touching `"), "directory", F.lit("/` ("), percent, F.lit(" of recent activity in that directory). Ownership is inferred from git history, not declared."))
    facts = found.select(F.lit("owner").alias("kind"), F.concat(F.lit("owner:"), "directory", F.lit(":"), "author").alias("topic"), F.concat("author", F.lit(" owns "), "directory", F.lit("/")).alias("short"), claim.alias("claim"), long.alias("long"), F.lit("commit").alias("source"), F.col("directory").alias("source_ref"), "valid_from", "confidence")
    return atoms_of(facts, source)


#: Adapters in the order in which they run.
ADAPTERS: dict[str, Callable[[Input], DataFrame]] = {
    "readme": _files(R.readme, ""), "manifest": _manifests, "schema": _files(R.schema_sql, "schema", (".sql",)), "invariants": _files(R.invariants, "invariants", (".sql",)),
    "git": _commits, "symbols": _files(R.symbols, "symbols", tuple(s for ends, _ in R.LANGUAGES.values() for s in ends)), "modules": _modules, "owners": _owners,
}


def run(source: Input, enabled: list[str] | None = None, budget_seconds: float | None = None) -> dict[str, Result]:
    """Results by adapter. Past the budget adapters are deferred; unknown names are skipped; an error stays with
    its adapter."""
    started, out = time.monotonic(), {}
    for name in ADAPTERS if enabled is None else enabled:
        if budget_seconds is not None and time.monotonic() - started >= budget_seconds:
            out[name] = Result(name, skipped="budget exhausted", deferred=True)
        elif name not in ADAPTERS:
            out[name] = Result(name, skipped=f"unknown ingester: {name}")
        else:
            try:
                out[name] = Result(name, cut(ADAPTERS[name](source)))
            except LookupError as reason:
                out[name] = Result(name, skipped=str(reason))
            except Exception as error:  # the outcome of one adapter is reported, not the end of all
                out[name] = Result(name, error=f"{type(error).__name__}: {str(error)[:200]}")
    return out


def summaries_of(rows: DataFrame) -> DataFrame:
    """Summaries at three lengths of rows with short, claim and long."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("resolution"), F.col(c).alias("text")) for n, c in ((10, "short"), (50, "claim"), (250, "long"))]))
    found = rows.select(F.col("id").alias("atom_id"), each.alias("s")).select("atom_id", "s.*").groupBy("atom_id", "resolution").agg(F.min("text").alias("text"))
    return found.withColumn("token_count", X.token_estimate(F.col("text"))).select(*[F.col(f.name).cast(f.dataType) for f in SUMMARIES])


def ingested(tables: dict[str, DataFrame], source: Input, enabled: list[str] | None = None, budget_seconds: float | None = None) -> tuple[dict[str, DataFrame], DataFrame, dict[str, Result]]:
    """(tables, report, results): atoms asserted over the stored ones, summaries, ROLLS_UP, OWNS, CO_CHANGED,
    REFERENCES and MIRRORS edges, atoms of deleted files closed.

    Of facts with one topic in one run the last by path and place holds. report: name, status, atoms.
    """
    spark = source.files.sparkSession
    results = run(source, enabled, budget_seconds)
    rows = None
    for i, r in enumerate(r for r in results.values() if r.rows is not None):
        part = r.rows.withColumn("__part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], ATOMS).withColumns({"short": F.lit(""), "claim": F.lit(""), "long": F.lit(""), "__part": F.lit(0), "__order": F.struct(F.lit(""), F.lit(0))})
    last = rows.groupBy("type", "topic_key", "workspace_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("__part", "__order")]), F.struct("__part", "__order")).alias("r")).select("r.*")
    last = cut(last)
    atoms = temporal.assert_facts(tables["atoms"], last.select(*tables["atoms"].columns))
    tracked = source.files.select("path")
    atoms = cut(discovery.reaped(atoms, source.deleted, tracked, source.now))
    summaries = tables["atom_summaries"].join(last.select(F.col("id").alias("atom_id")), "atom_id", "left_anti").unionByName(summaries_of(last))
    directory = F.col("source_ref").alias("directory")
    live = temporal.live(atoms)
    made = discovery.module_edges(live.where("tier = 'module' and topic_key like 'module:%'").select("id", directory), atoms)
    made = made.unionByName(discovery.owner_edges(live.where("type = 'owner'").select("id", directory), atoms)).select("src_id", "dst_id", "kind", "weight", F.array("evidence").alias("evidence"))
    empty = spark.createDataFrame([], "commit_id string, path string")
    changes = source.commit_files.select(F.col("sha").alias("commit_id"), "path") if source.commit_files is not None else empty
    found = made.unionByName(compose.discovered(atoms, summaries, changes).select("src_id", "dst_id", "kind", "weight", "evidence"))
    edges = edges_with(tables["edges"], cut(found), source.now)
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.col("__part").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ran = [n for n, r in results.items() if r.rows is not None]
    report = spark.createDataFrame([(n, r.status(), counts.get(ran.index(n), 0) if n in ran else 0) for n, r in results.items()], "name string, status string, atoms long")
    return {**tables, "atoms": atoms, "atom_summaries": summaries, "edges": edges}, report, results


def edges_with(edges: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Stored edges refreshed by found ones (src_id, dst_id, kind, weight): largest weight, status live again; new
    ones are added from now on. Closed edges stay closed."""
    from ..model import SYMMETRIC_KINDS

    given = found.select("src_id", "dst_id", "kind", "weight").withColumns({"confidence": F.lit(1.0), "status": F.lit("live"), "seq": F.lit(0)})
    new = merge.upserted_edges(given)
    open_ = edges.where("valid_to is null")
    joined = open_.join(new.select("src_id", "dst_id", "kind", F.col("weight").alias("__w"), F.col("confidence").alias("__c")), ["src_id", "dst_id", "kind"], "left")
    refreshed = joined.withColumns({"weight": F.greatest("weight", "__w"), "confidence": F.greatest("confidence", "__c"), "status": F.when(F.col("__w").isNotNull(), "live").otherwise(F.col("status"))}).select(*edges.columns)
    fresh = new.join(open_, ["src_id", "dst_id", "kind"], "left_anti")
    ident = F.substring(F.sha1(F.concat_ws("\0", "src_id", "dst_id", "kind", F.lit(str(now))).cast("binary")), 1, 16)
    made = fresh.withColumns({"id": ident, "directed": ~F.col("kind").isin(*SYMMETRIC_KINDS), "valid_from": F.lit(now), "valid_to": F.lit(None), "source": F.lit("shared_ref"), "created_at": F.lit(now)})
    return refreshed.unionByName(edges.where("valid_to is not null")).unionByName(made.select(*[F.col(f.name).cast(f.dataType) for f in EDGES]))


def due(last_sync: int, now: int, window: int = 90) -> int:
    """Seconds until a sync may run again; 0 if it may now, or none ever ran."""
    return max(0, window - (now - last_sync)) if last_sync else 0


def may_lock(held_since: int | None, now: int, stale: int = 900) -> bool:
    """Whether a single writer may start: nobody holds the lock, or who does has been silent for ``stale`` seconds."""
    return held_since is None or now - held_since > stale


def indexed(state: DataFrame, source: Input, results: dict[str, Result], head: str | None) -> DataFrame:
    """repo_state after a run: the commit, time, skipped atoms and notes; the commit stays as it was where an adapter
    was deferred."""
    deferred = any(r.deferred for r in results.values())
    notes = [f"{n}: {r.status()}" for n, r in results.items() if r.status() != "ok"]
    own = F.col("repo_id") == source.repo_id
    change = {"last_indexed_at": F.lit(source.now).cast("long"), "last_ingest_notes": F.array(*[F.lit(x) for x in notes]).cast("array<string>"), "last_atoms_skipped": F.lit(sum(1 for r in results.values() if r.error)).cast("int")}
    if not deferred:
        change["last_indexed_sha"] = F.lit(head)
    return state.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in change.items()})


def synced(tables: dict[str, DataFrame], source: Input, *, drifted: bool, last_sync: int, held_since: int | None, embed: Callable[[DataFrame], DataFrame] | None = None, force: bool = False, head: str | None = None) -> tuple[dict[str, DataFrame], str]:
    """(tables, outcome) of a sync: nothing unless drifted, debounced, one writer at a time; then ingest and, with
    ``embed`` (id, text) -> vectors, the missing vectors."""
    if not force and not drifted:
        return tables, "current"
    if not force and due(last_sync, source.now):
        return tables, "debounced"
    if not may_lock(held_since, source.now):
        return tables, "locked"
    tables, _, results = ingested(tables, source)
    if "repo_state" in tables:
        tables["repo_state"] = indexed(tables["repo_state"], source, results, head)
    if embed is not None:
        from .store import embedded

        tables["atom_vectors"] = embedded(tables, embed, now=source.now)
    return tables, "synced"
