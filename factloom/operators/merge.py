"""Order-independent merging of divergent copies: every field has a commutative aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_STATUS_RANK, LIVENESS_RANK


def _rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def merged_atoms(ours: DataFrame, theirs: DataFrame, key: list[str], stable: tuple[str, ...] = ()) -> DataFrame:
    """Earliest close, latest verification, sticky flags, united references, strongest liveness; other
    columns take the smallest value that is not null. Partial aggregation runs before the shuffle."""
    both = ours.unionByName(theirs)
    close = F.min(F.when(F.col("valid_to").isNotNull(), F.struct("valid_to", "superseded_by")))
    strongest = F.max(F.struct(F.when(F.col("liveness_kind").isNull(), -1).otherwise(_rank("liveness_kind", LIVENESS_RANK)).alias("rank"), "liveness_kind", "liveness_target", "liveness_pattern"))
    out = both.groupBy(*key).agg(
        close.alias("__close"), strongest.alias("__live"),
        F.max("liveness_last_ok").alias("liveness_last_ok"), F.max("updated_at").alias("updated_at"), F.min("created_at").alias("created_at"), F.min("confirm_by").alias("confirm_by"),
        F.bool_or("pinned").alias("pinned"), F.bool_or("archived").alias("archived"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("valid_in_refs")))).alias("valid_in_refs"),
        *[F.min(c).alias(c) for c in stable],
    )
    return out.select("*", "__close.*", "__live.liveness_kind", "__live.liveness_target", "__live.liveness_pattern").drop("__close", "__live")


def merged_edges(ours: DataFrame, theirs: DataFrame, key: list[str], stable: tuple[str, ...] = ()) -> DataFrame:
    """Largest weight and confidence, rejected over live over suggested, earliest close and creation."""
    both = ours.unionByName(theirs)
    status = F.max(F.struct(_rank("status", EDGE_STATUS_RANK).alias("rank"), "status"))
    return both.groupBy(*key).agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), status["status"].alias("status"), F.min("valid_to").alias("valid_to"), F.min("created_at").alias("created_at"), F.min("source").alias("source"), *[F.min(c).alias(c) for c in stable])


def merged_summaries(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The text whose word count is closest to the resolution, then the smaller text."""
    from ..functions.text import token_estimate, word_count

    both = ours.unionByName(theirs)
    best = F.min_by("text", F.struct(F.abs(word_count(F.col("text")) - F.col("resolution")), F.col("text")))
    return both.groupBy("atom_id", "resolution").agg(best.alias("text")).withColumn("token_count", token_estimate(F.col("text")))


def merged_evidence(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    return ours.unionByName(theirs).dropDuplicates(key)


def upserted_edges(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Edge refreshes (src_id, dst_id, kind, weight, confidence, status, seq): canonical endpoints for symmetric
    kinds, largest weight and confidence, last status. Self edges and weights or confidences outside of 0 to 1
    are left out (``edge_errors`` names them)."""
    from ..model import SYMMETRIC_KINDS

    swap = F.col("kind").isin(*SYMMETRIC_KINDS) & (F.col("src_id") > F.col("dst_id"))
    canonical = edges.where(edge_error().isNull()).withColumns({"src_id": F.when(swap, F.col("dst_id")).otherwise(F.col("src_id")), "dst_id": F.when(swap, F.col("src_id")).otherwise(F.col("dst_id"))})
    return canonical.groupBy(*(key or ["src_id", "dst_id", "kind"])).agg(F.max("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("status", "seq").alias("status"))


def edge_error() -> Column:
    """Why an edge is not accepted, or null."""
    outside = lambda c: F.col(c).isNull() | ~F.col(c).between(0.0, 1.0)
    return F.when(F.col("src_id") == F.col("dst_id"), "self edge").when(outside("weight"), "weight outside [0, 1]").when(outside("confidence"), "confidence outside [0, 1]")


def edge_errors(edges: DataFrame) -> DataFrame:
    return edges.select("src_id", "dst_id", "kind", edge_error().alias("error")).where("error is not null")


def upserted_evidence(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Evidence of refreshed edges: what is there already is not added again."""
    key = [c for c in stored.columns if c != "created_at"]
    return stored.unionByName(arriving).groupBy(*key).agg(F.min("created_at").alias("created_at")).select(*stored.columns)
