"""Re-checkable predicates: atoms joined to files, each with a state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, VERIFIED, FAILED, UNVERIFIABLE, TRUSTED, UNCONFIRMED = "none", "verified", "failed", "unverifiable", "trusted", "unconfirmed"


@lru_cache(maxsize=4096)
def compiled(pattern: str):
    try:
        return re.compile(pattern, re.M)
    except re.error:
        return None


def safe_path(target):
    """A target inside its root, or null: no absolute path and no way up."""
    return F.when(~target.startswith("/") & ~F.exists(F.split(target, "/"), lambda p: p == ".."), target)


def checked(atoms: DataFrame, files: DataFrame, symbols: DataFrame | None = None, *, now: int) -> DataFrame:
    """Atoms with ``state`` and a new liveness_last_ok where verified.

    regex: the pattern is found in the target file; a missing file, an escape from the root or a bad
    pattern fails. ast: the symbol is declared in the file; without symbols unverifiable. sql predicates
    need the store: see ``sql_holds``. Nothing to check is ``none``.
    """
    target = safe_path(F.col("liveness_target"))
    joined = atoms.withColumn("__path", target).join(files.select(F.col("path").alias("__path"), F.col("text").alias("__text")), "__path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [bool(t is not None and (r := compiled(p or "")) and r.search(t)) if k == "regex" else False for k, p, t in zip(batch["kind"], batch["pattern"], batch["text"])]
            yield pd.DataFrame({"id": batch["id"], "hit": hits})

    narrow = joined.where("liveness_kind = 'regex'").select("id", F.col("liveness_kind").alias("kind"), F.col("liveness_pattern").alias("pattern"), F.col("__text").alias("text"))
    hits = narrow.mapInPandas(run, "id string, hit boolean").groupBy("id").agg(F.bool_or("hit").alias("__hit"))
    out = joined.drop("__text").join(hits, "id", "left")
    if symbols is not None:
        known = symbols.select(F.col("path").alias("__path"), F.col("name").alias("liveness_pattern")).distinct().withColumn("__declared", F.lit(True))
        out = out.join(known, ["__path", "liveness_pattern"], "left")
    ast = F.when(F.coalesce(F.col("__declared"), F.lit(False)), VERIFIED).otherwise(FAILED) if symbols is not None else F.lit(UNVERIFIABLE)
    state = F.when(F.col("liveness_kind") == "regex", F.when(F.col("__hit"), VERIFIED).otherwise(FAILED)).when(F.col("liveness_kind") == "ast", ast).when(F.col("liveness_kind") == "sql", UNVERIFIABLE).otherwise(NONE)
    return out.withColumn("state", state).withColumn("liveness_last_ok", F.when(F.col("state") == VERIFIED, F.lit(now)).otherwise(F.col("liveness_last_ok"))).select(*atoms.columns, "state")


def sql_holds(spark: SparkSession, statement: str) -> str:
    """A single SELECT over the store's views that returns a row holds; anything else fails."""
    plain = statement.strip().rstrip(";")
    if ";" in plain or not re.match(r"(?i)(select|with)\b", plain):
        return FAILED
    try:
        return FAILED if spark.sql(plain).isEmpty() else VERIFIED
    except Exception:  # a predicate that does not run does not hold
        return FAILED


def at_retrieval(state, last_ok, confirm_by, now: int, fresh: int = 3600):
    """Trusted when verified a short while ago; unconfirmed past its horizon if there is nothing to check."""
    return F.when(last_ok.isNotNull() & (now - last_ok < fresh), TRUSTED).when((state == NONE) & (confirm_by < now), UNCONFIRMED).otherwise(state)


def at_emission(atoms: DataFrame, files: DataFrame, symbols: DataFrame | None, *, now: int, fresh: int = 3600) -> DataFrame:
    """``state`` of atoms about to be shown: none without a predicate, trusted where one passed less than
    ``fresh`` seconds ago, else what the check says now."""
    kind = F.coalesce("liveness_kind", F.lit("none"))
    trusted = (kind != "none") & F.coalesce(now - F.col("liveness_last_ok") < fresh, F.lit(False))
    found = checked(atoms, files, symbols, now=now)
    before = atoms.select("id", trusted.alias("__trusted"))
    return found.join(before, "id").withColumn("state", F.when(F.col("__trusted"), TRUSTED).otherwise(F.col("state"))).drop("__trusted")


def with_horizon(hits: DataFrame, now: int) -> DataFrame:
    """``unconfirmed`` in place of ``none`` past the horizon of confirmation."""
    late = (F.col("state") == NONE) & F.coalesce(F.col("confirm_by") < now, F.lit(False))
    return hits.withColumn("state", F.when(late, UNCONFIRMED).otherwise(F.col("state")))


def emitted(ranked: DataFrame, top: int) -> DataFrame:
    """The best ``top`` hits that did not fail: the next best takes a failed one's place."""
    return ranked.where((F.col("state") != FAILED) & (F.col("score") > 0)).orderBy(F.desc("score"), F.desc("id")).limit(top)


def swept(atoms: DataFrame, files: DataFrame, symbols: DataFrame | None = None, *, now: int, older: int = 86_400, batch: int = 50, most: int = 200) -> tuple[DataFrame, int]:
    """(atoms with new liveness_last_ok, batches run): stale predicates re-checked stalest first, a batch at a
    time, until none is left, a batch verifies nothing, or ``most`` batches ran."""
    from .stage import cut
    from .temporal import stale

    runs, tried = 0, None
    while runs < most:
        due = atoms.where("valid_to is null and not archived and liveness_kind is not null and liveness_kind <> 'none'")
        due = due if tried is None else due.join(tried, "id", "left_anti")
        take = cut(stale(due, now - older, limit=batch))
        if take.isEmpty():
            break
        state = cut(checked(take, files, symbols, now=now).select("id", "state"))
        runs += 1
        passed = state.where(F.col("state") == VERIFIED).select("id", F.lit(now).cast("long").alias("__ok"))
        atoms = cut(atoms.join(passed, "id", "left").withColumn("liveness_last_ok", F.coalesce("__ok", "liveness_last_ok")).drop("__ok").select(*atoms.columns))
        tried = state.select("id") if tried is None else tried.unionByName(state.select("id"))
        if passed.isEmpty():
            break
    return atoms, runs


def watched(atoms: DataFrame, files: DataFrame, paths: DataFrame, symbols: DataFrame | None = None, *, now: int) -> DataFrame:
    """id, topic_key, type, target, state of the live atoms with a predicate whose target or source is one of the paths."""
    hit = touching(atoms.where("liveness_kind is not null and liveness_kind <> 'none' and not archived"), paths)
    return checked(hit, files, symbols, now=now).select("id", "topic_key", "type", F.col("liveness_target").alias("target"), "state")


def touching(atoms: DataFrame, paths: DataFrame) -> DataFrame:
    """Live atoms whose target or source is one of the paths."""
    both = paths.select("path").distinct()
    source = F.regexp_replace("source_ref", r":\d+$", "")
    keyed = atoms.where("valid_to is null").withColumn("path", F.explode(F.array_distinct(F.filter(F.array(F.col("liveness_target"), source), lambda x: x.isNotNull()))))
    return keyed.join(both, "path", "left_semi").drop("path").distinct()
