"""Versions of facts: supersession, live views, as-of reads, reconciliation, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ATOM_TYPES, DECISION_CLASSES, DECISION_STATUSES, LIVENESS_KINDS, NATURAL_SOURCES, SOURCE_KINDS, TIERS

# fixed values: orders that a query may ask for
ORDERINGS = ("asserted_at DESC", "asserted_at ASC", "valid_from DESC", "valid_from ASC", "confidence DESC", "type ASC")


def versioned(claims: DataFrame, *, topic: list[str], order: list[str], claim: str, at: str, ident: str) -> DataFrame:
    """Claims in order of arrival become versions: valid_from, valid_to, superseded_by.

    A claim equal to the live one of its topic is a no-op; a divergent one closes it. A claim that
    comes back later is a version of its own. One shuffle on the topic.
    """
    along = Window.partitionBy(*topic).orderBy(*order)
    kept = claims.withColumn("__before", F.lag(claim).over(along)).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col(claim))).drop("__before")
    return kept.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(along)).withColumn("superseded_by", F.lead(ident).over(along))


def assert_facts(atoms: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving atoms over stored ones (columns of ``atoms``): closes, keeps or adds versions per topic. What
    ``validated`` rejects should be left out before."""
    keys = ["type", "topic_key", "workspace_id"]
    every = atoms.withColumn("__new", F.lit(0)).unionByName(arriving.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    live = every.where(F.col("valid_to").isNull())
    along = Window.partitionBy(*keys).orderBy("__new", "asserted_at", "id")
    kept = live.withColumn("__b", F.lag("id").over(along)).where(~F.col("__b").eqNullSafe(F.col("id"))).drop("__b")
    closed = kept.withColumn("superseded_by", F.coalesce("superseded_by", F.lead("id").over(along))).withColumn("valid_to", F.coalesce("valid_to", F.lead("asserted_at").over(along)))
    return closed.unionByName(every.where(F.col("valid_to").isNotNull())).drop("__new")


def contradictions(versions: DataFrame, *, ident: str = "id", source: str = "source_kind", natural: tuple[str, ...] = NATURAL_SOURCES) -> DataFrame:
    """CONTRADICTS edges from each closed version to its successor, unless its source diverges naturally."""
    closed = versions.where(F.col("superseded_by").isNotNull() & ~F.coalesce(F.col(source).isin(*natural), F.lit(False)))
    return closed.select(F.least(ident, "superseded_by").alias("src_id"), F.greatest(ident, "superseded_by").alias("dst_id"), F.lit("CONTRADICTS").alias("kind"))


def live(atoms: DataFrame) -> DataFrame:
    found = atoms.where(F.col("valid_to").isNull())
    return found.where(~F.col("archived")) if "archived" in atoms.columns else found


def constraints(atoms: DataFrame, kind: str = "constraint") -> DataFrame:
    return live(atoms).where(F.coalesce("decision_class", F.lit("constraint")) == kind)


def as_of(versions: DataFrame, at: int) -> DataFrame:
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def atom_error() -> Column:
    """Why an atom is not accepted, or null: confidence outside of 0 to 1, a value that no list has, a decision
    without status, a status without decision."""
    outside = F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0)
    known = lambda c, values: F.col(c).isNull() | F.col(c).isin(*values)
    decision = F.col("type") == "decision"
    return (
        F.when(F.col("type").isNull() | ~F.col("type").isin(*ATOM_TYPES), "unknown type")
        .when(outside, "confidence outside [0, 1]")
        .when(decision & F.col("decision_status").isNull(), "decision without status")
        .when(~decision & (F.col("decision_status").isNotNull() | F.col("decision_class").isNotNull()), "status of no decision")
        .when(~known("decision_status", DECISION_STATUSES), "unknown status")
        .when(~known("decision_class", DECISION_CLASSES), "unknown class")
        .when(~known("source_kind", SOURCE_KINDS), "unknown source")
        .when(~known("liveness_kind", LIVENESS_KINDS), "unknown predicate")
        .when(~known("tier", TIERS), "unknown tier")
    )


def validated(arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``) of arriving atoms. A decision without class is a change if it comes
    from a commit, else a constraint."""
    derived = F.when(F.col("source_kind") == "commit", "change").otherwise("constraint")
    rows = arriving.withColumn("decision_class", F.when(F.col("type") == "decision", F.coalesce("decision_class", derived)).otherwise(F.col("decision_class"))).withColumn("error", atom_error())
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def superseded(atoms: DataFrame, pairs: DataFrame, now: int) -> DataFrame:
    """Atoms closed by hand: pairs (old, new) of ids that both exist; a close that is there already stays."""
    ids = atoms.select("id").distinct()
    known = pairs.join(ids.withColumnRenamed("id", "old"), "old", "left_semi").join(ids.withColumnRenamed("id", "new"), "new", "left_semi")
    one = known.groupBy(F.col("old").alias("id")).agg(F.min("new").alias("__new"))
    joined = atoms.join(one, "id", "left")
    hit = F.col("__new").isNotNull()
    return joined.withColumns({"valid_to": F.when(hit, F.coalesce("valid_to", F.lit(now))).otherwise(F.col("valid_to")), "superseded_by": F.when(hit, F.col("__new")).otherwise(F.col("superseded_by"))}).select(*atoms.columns)


def missing(pairs: DataFrame, atoms: DataFrame, columns: tuple[str, ...] = ("old", "new")) -> DataFrame:
    """id of what is named but does not exist."""
    named = pairs.select(F.explode(F.array(*columns)).alias("id")).distinct()
    return named.join(atoms.select("id"), "id", "left_anti")


def history(atoms: DataFrame, topic: dict, order: tuple[str, ...] = ("valid_from", "asserted_at")) -> DataFrame:
    """All versions of a topic (column -> value), oldest first."""
    found = atoms
    for name, value in topic.items():
        found = found.where(F.col(name) == value)
    return found.orderBy(*order)


def topics_in(atoms: DataFrame, kind: str | None = None, workspace: str | None = None, topic: str = "topic_key") -> DataFrame:
    """Topics that have a live atom, of a type or workspace if named, ordered."""
    rows = live(atoms)
    rows = rows.where(F.col("type") == kind) if kind is not None else rows
    rows = rows.where(F.col("workspace_id") == workspace) if workspace is not None else rows
    return rows.select(topic).distinct().orderBy(topic)


def query_atoms(atoms: DataFrame, *, where: dict | None = None, order_by: str = "asserted_at DESC", ident: str = "id", limit: int = 50, live_only: bool = True, include_archived: bool = False) -> DataFrame:
    """Filtered, ordered, limited; the order is from an allow-list and made total by the id. decision_class
    matches its default, constraint, too."""
    if order_by not in ORDERINGS:
        raise ValueError(f"order_by must be one of {sorted(ORDERINGS)}")
    if not isinstance(limit, int) or not 1 <= limit <= 10_000:
        raise ValueError("limit must be in [1, 10000]")
    found = atoms.where("valid_to is null") if live_only else atoms
    if not include_archived and "archived" in atoms.columns:
        found = found.where(~F.col("archived"))
    for name, value in (where or {}).items():
        found = found.where((F.coalesce(name, F.lit("constraint")) if name == "decision_class" else F.col(name)) == value)
    column, direction = order_by.split()
    return found.orderBy(F.desc(column) if direction == "DESC" else F.asc(column), F.asc(ident)).limit(limit)


def reconciled(atoms: DataFrame, *, topic: list[str], ident: str = "id") -> DataFrame:
    """Of live rows that share a topic the latest valid_from, then the smallest id, survives; others close."""
    best = Window.partitionBy(*topic).orderBy(F.desc("valid_from"), F.asc(ident))
    whole = Window.partitionBy(*topic).orderBy(F.desc("valid_from"), F.asc(ident)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = atoms.withColumn("__n", F.row_number().over(best)).withColumn("survivor", F.first(ident).over(whole)).withColumn("__at", F.first("valid_from").over(whole))
    lost = F.col("__n") > 1
    return ranked.withColumn("valid_to", F.when(lost, F.col("__at"))).withColumn("superseded_by", F.when(lost, F.col("survivor"))).drop("__n", "__at", "survivor")


def decayed(score: Column, confidence: Column, age_from: Column, now: int, half_life_days: float = 90.0) -> Column:
    """score x confidence x 0.5 ^ (age / half life); future times have age 0."""
    age = F.greatest(F.lit(0), F.lit(now) - age_from)
    return score * confidence * F.pow(F.lit(0.5), age / (half_life_days * 86400.0))


def stale(atoms: DataFrame, cutoff: int, *, last_ok: str = "liveness_last_ok", ident: str = "id", limit: int = 50) -> DataFrame:
    """Never verified or not since ``cutoff``, stalest first, a bounded sweep."""
    found = atoms.where(F.col(last_ok).isNull() | (F.col(last_ok) < cutoff))
    return found.orderBy(F.coalesce(last_ok, F.lit(0)), ident).limit(limit)


def unconfirmed(atoms: DataFrame, now: int) -> DataFrame:
    """Live atoms past the horizon of their confirmation."""
    return live(atoms).where(F.col("confirm_by") < now)
