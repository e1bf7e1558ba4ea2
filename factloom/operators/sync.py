"""Divergent copies of a store: tagged export, merge of two exports, import with counts, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ATOMS, EDGES, EVIDENCE, NATURAL_SOURCES, SUMMARIES
from . import merge, temporal
from .stage import cut

#: Tables that are shared, with the key by which rows are the same.
EDGE_KEY = ["src_id", "dst_id", "kind", "valid_from"]
EVIDENCE_KEY = ["edge_src", "edge_dst", "edge_kind", "edge_valid_from", "kind", "payload"]
KEYS = {"atoms": ["id"], "atom_summaries": ["atom_id", "resolution"], "edges": EDGE_KEY, "edge_evidence": EVIDENCE_KEY}
SCHEMAS = {"atoms": ATOMS, "atom_summaries": SUMMARIES, "edges": EDGES, "edge_evidence": EVIDENCE}
STABLE = ("confidence", "repo_id", "workspace_id", "valid_from", "asserted_at", "decision_status", "decision_class", "tier", "source_kind", "source_ref", "source_lines")
#: Columns that the content of an id fixes.
IDENTITY = ("type", "topic_key")

Tables = dict[str, DataFrame]


def with_edge_keys(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence by the natural key of its edge instead of a local id; rows of no edge are left out."""
    names = edges.select(F.col("id").alias("edge_id"), F.col("src_id").alias("edge_src"), F.col("dst_id").alias("edge_dst"), F.col("kind").alias("edge_kind"), F.col("valid_from").alias("edge_valid_from"))
    return evidence.join(names, "edge_id").select(*EVIDENCE_KEY, "created_at")


def merged(ours: Tables, theirs: Tables) -> Tables:
    """Union of two copies, every field by a commutative, associative, idempotent rule. A copy may itself hold a
    key several times (in several shards): all its rows are merged."""
    atoms = merge.merged_atoms(ours["atoms"], theirs["atoms"], ["id"], stable=(*STABLE, *IDENTITY)).select(*[f.name for f in ATOMS])
    summaries = merge.merged_summaries(ours["atom_summaries"].select("atom_id", "resolution", "text"), theirs["atom_summaries"].select("atom_id", "resolution", "text"))
    extra = [c for c in ("directed", "id") if c in ours["edges"].columns and c in theirs["edges"].columns]
    edges = merge.merged_edges(ours["edges"], theirs["edges"], EDGE_KEY, stable=tuple(extra))
    both = ours["edge_evidence"].unionByName(theirs["edge_evidence"])
    evidence = both.groupBy(*EVIDENCE_KEY).agg(F.min("created_at").alias("created_at"))
    return {"atoms": atoms, "atom_summaries": summaries, "edges": edges, "edge_evidence": evidence}


def rendered_tables(tables: Tables) -> DataFrame:
    """table, key, line of all rows, to be ordered by (table, key): canonical JSON, byte for byte the same for the
    same content."""
    from ..sources.jsonl import rendered

    parts = []
    for name, df in tables.items():
        columns = [c for c in df.columns if not (name == "edges" and c == "id")]
        key = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS[name]])).alias("key")
        parts.append(rendered(df.withColumn("key", key), name, columns, keep=["key"]).select(F.lit(name).alias("table"), "key", "line"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parsed_lines(lines: DataFrame) -> Tables:
    """Tables by name from tagged lines (column value); broken lines and unknown tables are left out."""
    from ..sources.jsonl import tables_of

    wire = {"edge_evidence": "edge_src string, edge_dst string, edge_kind string, edge_valid_from long, kind string, payload string, created_at long"}
    return tables_of(lines, {n: wire.get(n, s) for n, s in SCHEMAS.items()})


def merged_lines(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """table, key, line of the merge of two exports given as lines: never a conflict."""
    a, b = parsed_lines(ours), parsed_lines(theirs)
    for side in (a, b):
        side["edges"] = side["edges"].drop("id")
    return rendered_tables(merged(a, b))


def imported(local: Tables, arriving: Tables, now: int) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables, counts, conflicts) after a union of a store with an import that deletes nothing.

    counts: table, inserted, updated, unchanged. Summaries, edges and evidence whose atoms or edge are nowhere are
    skipped. Topics left with several live atoms are reconciled once, at the end; conflicts lists topic_key and the
    atom that stays, but for sources that evolve naturally.
    """
    both = merged(local, arriving)
    known = cut(both["atoms"])
    names = known.select("id")
    both["atoms"] = known
    both["atom_summaries"] = both["atom_summaries"].join(names.withColumnRenamed("id", "atom_id"), "atom_id", "left_semi")
    edges = both["edges"].join(names.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(names.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    both["edges"] = cut(edges)
    ends = both["edges"].select(F.col("src_id").alias("edge_src"), F.col("dst_id").alias("edge_dst"), F.col("kind").alias("edge_kind"), F.col("valid_from").alias("edge_valid_from"))
    both["edge_evidence"] = both["edge_evidence"].join(ends, EVIDENCE_KEY[:4], "left_semi")
    counts = counted("atoms", local["atoms"], both["atoms"], arriving["atoms"]).unionByName(counted("edges", local["edges"], both["edges"], arriving["edges"]))
    atoms, raised = reconciled(known, now)
    both["atoms"] = atoms
    return both, counts, raised


def counted(name: str, before: DataFrame, after: DataFrame, arriving: DataFrame) -> DataFrame:
    """table, inserted, updated, unchanged among the rows of the import."""
    key = KEYS[name]
    columns = sorted(c for c in after.columns if c in before.columns and c not in key and c != "id")
    state = F.xxhash64(*[F.col(c) for c in columns])
    old = before.groupBy(*key).agg(F.min(state).alias("__old"))
    new = after.select(*key, state.alias("__new")).join(arriving.select(*key).distinct(), key, "left_semi")
    joined = new.join(old, key, "left")
    return joined.agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old") != F.col("__new")).alias("updated"), F.count_if(F.col("__old") == F.col("__new")).alias("unchanged")).select(F.lit(name).alias("table"), "inserted", "updated", "unchanged")


def reconciled(atoms: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(atoms, conflicts): of the live atoms of one type, topic and workspace the latest valid_from, then the
    smallest id, stays; the others close now. conflicts (topic_key, kept, closed) where not both evolve naturally."""
    topic = ["type", "topic_key", "workspace_id"]
    live = atoms.where("valid_to is null")
    best = live.groupBy(*topic).agg(F.count(F.lit(1)).alias("n"), F.max("valid_from").alias("at")).where("n > 1")
    kept = live.join(best, topic).where("valid_from = at").groupBy(*topic).agg(F.min(F.struct("id", "source_kind")).alias("kept"))
    lost = cut(live.join(kept, topic).where(F.col("id") != F.col("kept.id")).select("id", F.col("kept.id").alias("__kept"), F.col("kept.source_kind").alias("__kind")))
    joined = atoms.join(lost, "id", "left")
    gone = F.col("__kept").isNotNull()
    closed = joined.withColumns({"valid_to": F.when(gone, F.lit(now).cast("long")).otherwise(F.col("valid_to")), "superseded_by": F.when(gone, F.col("__kept")).otherwise(F.col("superseded_by")), "updated_at": F.when(gone, F.lit(now).cast("long")).otherwise(F.col("updated_at"))})
    natural = F.col("source_kind").isin(*NATURAL_SOURCES) & F.col("__kind").isin(*NATURAL_SOURCES)
    conflicts = joined.where(gone & ~F.coalesce(natural, F.lit(False))).select("topic_key", F.col("__kept").alias("kept"), F.col("id").alias("closed"))
    return closed.select(*atoms.columns), conflicts


def conflict_edges(conflicts: DataFrame) -> DataFrame:
    """CONTRADICTS edges of reconciled topics."""
    return conflicts.select(F.least("kept", "closed").alias("src_id"), F.greatest("kept", "closed").alias("dst_id"), F.lit("CONTRADICTS").alias("kind"), F.lit("llm_extract").alias("source")).distinct()


def topics_settled(atoms: DataFrame) -> DataFrame:
    """Live topics, each once: topic_key."""
    return temporal.live(atoms).select("topic_key").distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True)
