"""Captured facts on their way to memory: extraction, queue, review, noise, promotion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guard
from ..functions import text as X
from ..model import ATOMS, CANDIDATES
from . import near, temporal
from .stage import cut

#: Days until an accepted fact wants to be confirmed again (fixed value).
CONFIRM_DAYS = 90
NEAR = 0.6


def excluded(unit: F.Column, terms: tuple[str, ...]) -> F.Column:
    """Whether a clause holds a term of the denylist as a whole word."""
    listed = "|".join(re.escape(t) for t in terms if t)
    return unit.rlike(rf"(?i)\b({listed})\b") if listed else F.lit(False)


def clauses(messages: DataFrame, *, keep: list[str], text: str = "text", policy: guard.Policy = guard.Policy(), exclude_terms: tuple[str, ...] = ()) -> DataFrame:
    """keep, at, unit, dropped, score, signals of every clause of messages that are a person talking.

    ``dropped`` names the hard rule that removes a clause (the guard's first), or ``excluded``.
    """
    rows = messages.where(X.spoken(F.col(text))).select(*keep, F.posexplode(X.units(F.col(text))).alias("at", "unit"))
    guarded = rows.withColumn("__guarded", F.size(guard.findings(F.col("unit"), policy)) > 0)
    reason = F.coalesce(X.drop_reason(F.col("unit"), F.col("__guarded")), F.when(excluded(F.col("unit"), exclude_terms), "excluded"))
    return guarded.select(*keep, "at", "unit", reason.alias("dropped"), X.capture_score(F.col("unit")).alias("score"), X.capture_signals(F.col("unit")).alias("signals"))


def captured(messages: DataFrame, *, ident: str = "id", text: str = "text", threshold: int = X.THRESHOLD, policy: guard.Policy = guard.Policy(), exclude_terms: tuple[str, ...] = ()) -> DataFrame:
    """fingerprint, id, at, unit, score, signals, proposed_type: rule-like clauses of messages; of clauses
    with one fingerprint the first by id and place."""
    rows = clauses(messages.withColumnRenamed(ident, "id"), keep=["id"], text=text, policy=policy, exclude_terms=exclude_terms)
    kept = rows.where(F.col("dropped").isNull() & (F.col("score") >= threshold)).withColumn("fingerprint", X.fingerprint(F.col("unit")))
    first = kept.groupBy("fingerprint").agg(F.min(F.struct("id", "at", "unit", "score", "signals")).alias("r"))
    return first.select("fingerprint", "r.*", X.proposed_type(F.col("r.signals")).alias("proposed_type"))


def queued(found: DataFrame, stored: DataFrame, least: float = NEAR) -> DataFrame:
    """Candidates to store, of ``found`` (fingerprint, id, at, unit): not known, not near a rejected or pending
    one, nor near an earlier one of the batch; accepted ones do not block unless equal."""
    fresh = cut(found.join(stored.select("fingerprint"), "fingerprint", "left_anti"))
    blocked = near.near_any(fresh, stored.where("status in ('rejected', 'pending')").select(F.col("text").alias("unit")), ident="fingerprint", text="unit", least=least)
    remaining = cut(fresh.join(blocked, "fingerprint", "left_anti").withColumn("__place", F.struct("id", "at", "fingerprint")))
    order = near.greedy(remaining, ident="__place", text="unit", least=least).where("kept")
    return remaining.join(order.select("__place"), "__place", "left_semi").drop("__place")


def enqueued(found: DataFrame, stored: DataFrame, now: int, source: str = "transcript", session: str = "id") -> DataFrame:
    """The table of candidates with the queued ones pending; what is known by fingerprint stays as it is, so a
    rejection is permanent."""
    new = queued(found, stored)
    rows = {"text": F.col("unit"), "source": F.lit(source), "session_id": F.col(session).cast("string"), "created_at": F.lit(now), "status": F.lit("pending")}
    columns = [(rows.get(f.name) if f.name in rows else F.col(f.name) if f.name in new.columns else F.lit(None)) for f in CANDIDATES]
    return stored.unionByName(new.select(*[F.lit(None).cast(f.dataType).alias(f.name) if c is None else c.cast(f.dataType).alias(f.name) for c, f in zip(columns, CANDIDATES)]))


def pending(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """What waits for review: the highest score, then the oldest, first."""
    return candidates.where("status = 'pending'").orderBy(F.desc("score"), "created_at", "fingerprint").limit(limit)


def by_prefix(candidates: DataFrame, prefix: str) -> DataFrame:
    """The one candidate whose fingerprint starts so; no row where none or several do."""
    two = candidates.where(F.col("fingerprint").startswith(prefix)).limit(2)
    return cut(two).withColumn("__n", F.expr("count(1) over ()")).where("__n = 1").drop("__n")  # two rows


def noise(candidates: DataFrame, *, policy: guard.Policy = guard.Policy(), threshold: int = X.THRESHOLD, least: float = NEAR) -> DataFrame:
    """fingerprint, rule: pending candidates that would not be proposed now, or that are near a rejected one."""
    waiting = candidates.where("status = 'pending'").select("fingerprint", "text")
    rows = cut(waiting.withColumn("__guarded", F.size(guard.findings(F.col("text"), policy)) > 0).select("fingerprint", "text", X.explained(F.col("text"), F.col("__guarded"), threshold).alias("rule")))
    close = near.near_any(rows.where("rule is null"), candidates.where("status = 'rejected'").select("text"), ident="fingerprint", text="text", least=least)
    return rows.where("rule is not null").select("fingerprint", "rule").unionByName(close.select("fingerprint", F.lit("near-duplicate").alias("rule")))


def suggested(candidates: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Candidates with the advice that is recorded for them: verdict (accept or reject) and reason, white space
    collapsed and cut at 500 characters; of several the latest by ``at``. Advice changes no status."""
    valid = suggestions.where(F.col("verdict").isin("accept", "reject"))
    reason = F.substring(X.stripped(F.regexp_replace("reason", r"\s+", " ")), 1, 500)
    last = valid.withColumn("reason", reason).groupBy("fingerprint").agg(F.max_by(F.struct("verdict", "reason"), F.struct("at", "verdict", "reason")).alias("advice"))
    return candidates.join(last, "fingerprint", "left").select(*candidates.columns, F.col("advice.verdict").alias("verdict"), F.col("advice.reason").alias("reason"))


def reviewed(candidates: DataFrame, decisions: DataFrame, now: int, confirm_days: int = CONFIRM_DAYS) -> tuple[DataFrame, DataFrame]:
    """(candidates, new atoms) after decisions (fingerprint, verdict accepted or rejected): only pending ones
    change. An accepted one becomes an atom of tier module from a manual source, to be confirmed again in
    ``confirm_days`` days, with a topic from its fingerprint."""
    joined = candidates.join(decisions.select("fingerprint", "verdict"), "fingerprint", "left")
    change = (F.col("status") == "pending") & F.coalesce(F.col("verdict").isin("accepted", "rejected"), F.lit(False))
    taken = change & (F.col("verdict") == "accepted")
    topic = F.concat(F.lit("captured:"), F.col("fingerprint"))
    ident = X.content_id(F.col("proposed_type"), topic, F.col("text"))
    marked = cut(joined.withColumns({"__change": change, "__taken": taken, "__id": ident, "__topic": topic}))
    after = marked.withColumns({"status": F.when(F.col("__change"), F.col("verdict")).otherwise(F.col("status")), "reviewed_at": F.when(F.col("__change"), F.lit(now)).otherwise(F.col("reviewed_at")), "atom_id": F.when(F.col("__taken"), F.col("__id")).otherwise(F.col("atom_id"))})
    given = {
        "id": F.col("__id"), "type": F.col("proposed_type"), "topic_key": F.col("__topic"), "tier": F.lit("module"), "source_kind": F.lit("manual"), "source_ref": F.col("source_ref"),
        "decision_status": F.when(F.col("proposed_type") == "decision", "CLOSED"), "decision_class": F.when(F.col("proposed_type") == "decision", "constraint"),
        "valid_from": F.lit(now), "asserted_at": F.lit(now), "created_at": F.lit(now), "updated_at": F.lit(now), "confirm_by": F.lit(now + confirm_days * 86_400), "confidence": F.lit(1.0),
        "workspace_id": F.lit("default"), "pinned": F.lit(False), "archived": F.lit(False), "valid_in_refs": F.array(),
    }
    atoms = marked.where("__taken").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ATOMS], F.col("text").alias("__text"))
    return after.select(*candidates.columns), atoms


def accepted_into(atoms: DataFrame, candidates: DataFrame, decisions: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(atoms, candidates) after a review: accepted facts are asserted like any other."""
    after, new = reviewed(candidates, decisions, now)
    return temporal.assert_facts(atoms, new.drop("__text")), after
