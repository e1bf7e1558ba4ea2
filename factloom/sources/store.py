"""The fact store: Parquet snapshots with explicit schemas, views, upserts, sync and configuration."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guard
from ..functions import text as X
from ..model import ATOMS, RESOLUTIONS, TABLES
from ..operators import temporal
from .jsonl import keep_last

#: Version of today's schema (fixed value).
SCHEMA_VERSION = 7


@dataclass
class Config:
    """Settings of a store by section; unknown sections and keys of a file are ignored."""

    half_life_days: float = 90.0
    min_relevance: float = 0.0
    seed_k: int = 10
    top_n: int = 20
    guard_enabled: bool = True
    guard_allow: list[str] = field(default_factory=list)
    exclude_terms: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: [".git", "node_modules", "__pycache__"])
    max_file_kb: int = 512
    roots: list[str] = field(default_factory=lambda: ["."])

    @classmethod
    def load(cls, path: str) -> Config:
        """From TOML, plain or as sections retrieval, guard, capture, scan, workspace; a file that is not there gives
        the defaults."""
        data = tomllib.loads(Path(path).read_text()) if Path(path).exists() else {}
        places = {"half_life_days": "retrieval", "min_relevance": "retrieval", "seed_k": "retrieval", "top_n": "retrieval", "guard_enabled": "guard.enabled", "guard_allow": "guard.allow_patterns", "exclude_terms": "capture", "exclude": "scan", "max_file_kb": "scan", "roots": "workspace"}
        given = {}
        for f in fields(cls):
            section, _, key = places[f.name].partition(".")
            table = data.get(section, {})
            if isinstance(table, dict) and (key or f.name) in table:
                given[f.name] = table[key or f.name]
            elif f.name in data:
                given[f.name] = data[f.name]
        return cls(**given)

    def policy(self) -> guard.Policy:
        return guard.Policy(self.guard_enabled, tuple(self.guard_allow), tuple(self.exclude_terms))


def set_min_relevance(path: str, value: float) -> None:
    """Writes one key of section retrieval and leaves all else of the file as it stands; the file is replaced at once."""
    lines = Path(path).read_text().splitlines(keepends=True) if Path(path).exists() else []
    text, at = f"min_relevance = {value:g}\n", None
    section = ""
    for i, line in enumerate(lines):
        if m := re.match(r"\s*\[([^\[\]]+)\]", line):
            section = m[1].strip()
            at = i + 1 if section == "retrieval" and at is None else at
        elif section == "retrieval" and re.match(r"\s*min_relevance\s*=", line):
            lines[i], text = text, ""
            break
    if text:
        if at is None:
            lines += [] if not lines or lines[-1].endswith("\n") else ["\n"]
            lines += ["[retrieval]\n", text]
        else:
            lines.insert(at, text)
    new = Path(path + ".new")
    new.write_text("".join(lines))
    new.replace(path)


class Store:
    """Tables under a folder in any store that Spark reads; each write replaces a table's snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create_empty(self) -> int:
        """Zero-row Parquet for every table that is not there; idempotent."""
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/v0")
        return SCHEMA_VERSION

    def read(self, name: str, version: int = 0) -> DataFrame:
        """A snapshot; columns that an older one lacks are null."""
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{version}")

    def write(self, name: str, df: DataFrame, version: int) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]).write.mode("overwrite").parquet(f"{self.path}/{name}/v{version}")

    def views(self, version: int = 0) -> None:
        """live_atoms, live_edges, invariants_live, closed_decisions, constraints_live."""
        atoms, edges = self.read("atoms", version), self.read("edges", version)
        live = temporal.live(atoms)
        live.createOrReplaceTempView("live_atoms")
        edges.where("valid_to is null and status = 'live'").createOrReplaceTempView("live_edges")
        live.where("type = 'invariant'").createOrReplaceTempView("invariants_live")
        live.where("decision_status = 'CLOSED'").createOrReplaceTempView("closed_decisions")
        temporal.constraints(atoms).where("decision_status = 'CLOSED'").createOrReplaceTempView("constraints_live")


def get_atom(atoms: DataFrame, summaries: DataFrame, ident: str, include_archived: bool = False) -> DataFrame:
    """The atom with its summaries as a map from resolution to text."""
    found = atoms.where(F.col("id") == ident)
    found = found if include_archived else found.where(~F.col("archived"))
    texts = summaries.groupBy(F.col("atom_id").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("resolution", "text")))).alias("summaries"))
    return found.join(texts, "id", "left")


class Ambiguous(LookupError):
    """A name that several atoms answer to."""


def resolve(atoms: DataFrame, name: str, probes: int = 5) -> str | None:
    """The id that a name - an id or a topic - stands for; None if no live atom has it. Raises ``Ambiguous`` with the
    first ids where a topic has several."""
    live = temporal.live(atoms)
    for condition in (F.col("id") == name, F.col("topic_key") == name):
        found = [r["id"] for r in live.where(condition).select("id").distinct().orderBy("id").limit(probes).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise Ambiguous(f"{name}: {', '.join(found)}")
    return None


def upsert(stored: DataFrame, arriving: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest row of each key, arriving over stored."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(arriving.withColumn("__new", F.lit(1)))
    return keep_last(both, key, ["__new", order]).drop("__new")


def summaries_upserted(stored: DataFrame, arriving: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, rejected): arriving texts (atom_id, resolution, text) replace those of their resolution, tokens are
    counted anew; an unknown resolution or atom is rejected with ``error``."""
    known = arriving.join(atoms.select(F.col("id").alias("atom_id"), F.lit(True).alias("__known")).distinct(), "atom_id", "left")
    error = F.when(~F.col("resolution").isin(*RESOLUTIONS), "resolution").when(F.col("__known").isNull(), "atom not found")
    judged = known.withColumn("error", error).drop("__known")
    good = judged.where("error is null").groupBy("atom_id", "resolution").agg(F.max("text").alias("text"))
    kept = stored.join(good.select("atom_id", "resolution"), ["atom_id", "resolution"], "left_anti")
    return kept.unionByName(good.withColumn("token_count", X.token_estimate(F.col("text"))).select(*stored.columns)), judged.where("error is not null")


def register_repo(state: DataFrame, arriving: DataFrame) -> DataFrame:
    """Repos by id: a new root path replaces the old one, what was indexed stays."""
    both = state.join(arriving.select("repo_id", F.col("root_path").alias("__root")), "repo_id", "full")
    return both.withColumn("root_path", F.coalesce("__root", "root_path")).select(*state.columns)


def repo_id(path: str) -> F.Column:
    """12 hex digits of SHA-1 of an absolute path."""
    return F.substring(F.sha1(F.lit(path).cast("binary")), 1, 12)


def record_session(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Upsert that keeps each session's first started_at."""
    last = upsert(stored, arriving, ["session_id"], "started_at").drop("started_at")
    first = stored.unionByName(arriving).groupBy("session_id").agg(F.min("started_at").alias("started_at"))
    return last.join(first, "session_id").select(*stored.columns)


def handoff_session(sessions: DataFrame, session: str, now: int, *, reason: str, path: str, branch: str | None = None, head: str | None = None, context: float | None = None) -> DataFrame:
    """Sessions with the end of one: when, why, the hand-over's path, branch and commit; one not known starts now."""
    spark = sessions.sparkSession
    schema = sessions.schema
    row = {"session_id": session, "started_at": now, "ended_at": now, "ended_reason": reason, "context_pct_end": context, "handoff_path": path, "branch": branch, "last_commit_sha": head}
    return record_session(sessions, spark.createDataFrame([tuple(row[f.name] for f in schema)], schema))


def persisted_plan(atoms: DataFrame, summaries: DataFrame, report: DataFrame, goal: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(atoms, summaries) with a plan (column plan, JSON) as a closed change decision; it supersedes nothing."""
    parsed = F.from_json("plan", "goal string, tasks array<struct<title:string>>, constraints array<struct<id:string>>")
    one = report.select(parsed.alias("p"), X.slug(F.lit(goal)).alias("slug"))
    listed = lambda items, none, mark: F.when(F.size(items) > 0, F.array_join(items, mark)).otherwise(none)
    claim = F.lit(f"Plan for: {goal}")
    long = F.concat(claim, F.lit("\n\nTasks: "), listed(F.col("p.tasks.title"), "(no surface atoms retrieved)", "; "), F.lit("\n\nConstraints consulted: "), listed(F.col("p.constraints.id"), "(none)", ", "))
    topic = F.concat(F.lit("plan:"), "slug")
    given = {"id": X.content_id(F.lit("decision"), topic, claim), "type": F.lit("decision"), "topic_key": topic, "decision_status": F.lit("CLOSED"), "decision_class": F.lit("change"), "tier": F.lit("symbol"), "source_kind": F.lit("manual"), "confidence": F.lit(1.0), "workspace_id": F.lit("default"), "pinned": F.lit(False), "archived": F.lit(False), "valid_in_refs": F.array()}
    given |= {c: F.lit(now) for c in ("valid_from", "asserted_at", "created_at", "updated_at")}
    row = one.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ATOMS], claim.alias("__claim"), long.alias("__long"))
    new = row.join(temporal.live(atoms).select("id"), "id", "left_anti")
    texts = new.select(F.col("id").alias("atom_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("resolution"), t.alias("text")) for n, t in ((10, F.lit(goal[:80])), (50, F.col("__claim")), (250, F.col("__long")))])).alias("s")).select("atom_id", "s.*")
    out, _ = summaries_upserted(summaries, texts, new.select("id"))
    return atoms.unionByName(new.select(*atoms.columns)), out


def pending_embeddings(atoms: DataFrame, summaries: DataFrame, vectors: DataFrame, model: str, resolution: int = 50, limit: int = 500) -> DataFrame:
    """Live atoms whose vector is missing, of another model or of another text; pinned ones and the most
    recent first."""
    texts = temporal.live(atoms).join(summaries.where(F.col("resolution") == resolution).select(F.col("atom_id").alias("id"), "text"), "id")
    known = vectors.select(F.col("atom_id").alias("id"), F.col("model").alias("__model"), F.col("hash").alias("__hash"))
    own = F.substring(F.sha1(F.col("text").cast("binary")), 1, 16)
    joined = texts.join(known, "id", "left").where(F.col("__model").isNull() | (F.col("__model") != model) | (F.col("__hash") != own))
    return joined.orderBy(F.desc("pinned"), F.desc(F.coalesce(F.col("type") == "decision", F.lit(False))), F.desc("asserted_at"), "id").limit(limit).select("id", "text", own.alias("hash"))


def embedded(tables: dict[str, DataFrame], embed: Callable[[DataFrame], DataFrame], *, model: str = "hash-3gram-v1", now: int, resolution: int = 50, limit: int = 500) -> DataFrame:
    """The table of vectors with those of pending atoms written: ``embed`` maps (id, text) to (id, vector)."""
    due = pending_embeddings(tables["atoms"], tables["atom_summaries"], tables["atom_vectors"], model, resolution, limit)
    made = embed(due.select("id", "text")).join(due.select("id", "hash"), "id")
    new = made.select(F.col("id").alias("atom_id"), F.lit(model).alias("model"), F.lit(resolution).alias("resolution"), "hash", F.col("vector").cast("array<float>").alias("vector"), F.lit(now).cast("long").alias("embedded_at"))
    return upsert(tables["atom_vectors"], new, ["atom_id"], "embedded_at")


def embed_status(atoms: DataFrame, summaries: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row: live atoms, vectors of the model, atoms without one, all models present, and whether they mix or
    lack the querying one."""
    live = temporal.live(atoms).select(F.col("id").alias("atom_id"))
    own = vectors.join(live, "atom_id", "left_semi")
    n = live.agg(F.count(F.lit(1)).alias("live"))
    counted = own.agg(F.count_if(F.col("model") == model).alias("embedded"), F.sort_array(F.collect_set("model")).alias("models"))
    unembedded = live.join(own.where(F.col("model") == model).select("atom_id"), "atom_id", "left_anti").agg(F.count(F.lit(1)).alias("unembedded"))
    one = n.crossJoin(counted).crossJoin(unembedded)  # one row each
    return one.withColumns({"mixed": F.size("models") > 1, "mismatch": (F.size("models") > 0) & ~F.array_contains("models", model)})


def stored_models(vectors: DataFrame, atoms: DataFrame) -> DataFrame:
    """model, n of the vectors of live atoms."""
    live = temporal.live(atoms).select(F.col("id").alias("atom_id"))
    return vectors.join(live, "atom_id", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def guard_withheld(atoms: DataFrame, summaries: DataFrame, edges: DataFrame, evidence: DataFrame, kinds) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without what must not leave - atoms whose topic or texts are flagged, their summaries, touching edges
    and evidence, flagged evidence by itself - and a report (id, kinds); the evidence's is charged to its edge's
    source. kinds: text Column -> array of kinds."""
    texts = summaries.select(F.col("atom_id").alias("id"), "text").unionByName(atoms.select("id", F.col("topic_key").alias("text")))
    found = texts.select("id", F.explode(kinds(F.col("text"))).alias("kind")).distinct()
    bad = found.select("id").distinct()
    kept_edges = edges.join(bad.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(bad.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select(*edges.columns)
    judged = evidence.withColumn("__kinds", kinds(F.col("payload")))
    standing = kept_edges.select(F.col("id").alias("edge_id"), F.col("src_id").alias("__src"))
    lone = judged.where(F.size("__kinds") > 0).join(standing, "edge_id").select(F.col("__src").alias("id"), F.explode("__kinds").alias("kind"))
    kept_evidence = judged.where(F.size("__kinds") == 0).join(standing, "edge_id", "left_semi").select(*evidence.columns)
    report = found.unionByName(lone).groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    tables = {"atoms": atoms.join(bad, "id", "left_anti").select(*atoms.columns), "atom_summaries": summaries.join(bad.withColumnRenamed("id", "atom_id"), "atom_id", "left_anti").select(*summaries.columns), "edges": kept_edges, "edge_evidence": kept_evidence}
    return tables, report


def migrated(df: DataFrame, name: str, backfill: dict | None = None) -> DataFrame:
    """A table of an older version in today's schema: missing columns null or by ``backfill`` Columns."""
    for column, value in (backfill or {}).items():
        df = df.withColumn(column, F.coalesce(F.col(column), value) if column in df.columns else value)
    for f in TABLES[name]:
        df = df if f.name in df.columns else df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])


#: What older versions lack (fixed values): column -> value where a row has none.
def backfills() -> dict[str, dict]:
    commit = F.col("source_kind") == "commit"
    return {
        "atoms": {
            "tier": F.when(F.col("topic_key").startswith("module:"), "module").otherwise("symbol"), "workspace_id": F.lit("default"), "confidence": F.lit(1.0), "pinned": F.lit(False), "archived": F.lit(False),
            "decision_class": F.when(F.col("type") == "decision", F.when(commit, "change").otherwise("constraint")),
        },
        "edges": {"status": F.lit("live"), "confidence": F.lit(1.0), "directed": ~F.col("kind").isin("CONTRADICTS", "CO_CHANGED", "MIRRORS")},
        "repo_state": {"last_atoms_skipped": F.lit(0)},
    }


def migrated_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of any older version in today's schema, missing columns filled as above, missing tables empty."""
    fills = backfills()
    out = {name: migrated(df, name, fills.get(name)) for name, df in tables.items() if name in TABLES}
    spark = next(iter(tables.values())).sparkSession
    return out | {name: spark.createDataFrame([], TABLES[name]) for name in TABLES if name not in out}


# --- probes of version control, from exported logs ----------------------------------------------------------


def head_sha(log: DataFrame) -> str | None:
    """The newest commit of a log (sha, ts); None if it is empty."""
    row = log.orderBy(F.desc("ts"), "sha").select("sha").first()
    return row["sha"] if row else None


def commits_since(log: DataFrame, base: str | None) -> DataFrame | None:
    """Commits newer than ``base``; None - unknown, not none - where the log does not have it."""
    if base is None:
        return None
    at = log.where(F.col("sha") == base).agg(F.max("ts")).first()[0]
    return None if at is None else log.where((F.col("ts") >= at) & (F.col("sha") != base))


def commits_behind(log: DataFrame, base: str | None) -> int | None:
    found = commits_since(log, base)
    return None if found is None else found.count()


def changed_since(log: DataFrame, commit_files: DataFrame, base: str | None, dirty: DataFrame | None = None) -> DataFrame | None:
    """path of committed and working-tree changes since ``base``; None if unknown."""
    found = commits_since(log, base)
    if found is None:
        return None
    paths = commit_files.join(found.select("sha"), "sha", "left_semi").select("path")
    return (paths.unionByName(dirty.select("path")) if dirty is not None else paths).distinct()


def deleted_since(log: DataFrame, commit_files: DataFrame, base: str | None, tracked: DataFrame) -> DataFrame | None:
    """path of files that were changed since ``base`` and are not tracked any more; None if unknown."""
    changed = changed_since(log, commit_files, base)
    return None if changed is None else changed.join(tracked.select("path"), "path", "left_anti")


def tracked_under(tracked: DataFrame, directory: str) -> int:
    return tracked.where(F.col("path").startswith(directory.rstrip("/") + "/")).count()
