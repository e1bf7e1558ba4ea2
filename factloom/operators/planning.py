"""Plans, edge cases, digests, drift, pulse: compositions over atoms and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import temporal

# fixed values
CONSTRAINT_RANK = {"schema_fact": 0, "invariant": 1}
SEVERITY = {"high": 0, "med": 1, "low": 2}
FINGERPRINTS = {".css": ("perf_hotpath",), ".scss": ("perf_hotpath",), ".md": (), ".sql": ("schema_migration", "cross_repo_impact", "backwards_compat", "invariant_risk")}
CHANGED_SYMBOLS = (r"\b(?:def|class|func|fn)\s+([A-Za-z_][\w$]*)", r"\b([A-Z][A-Za-z0-9_]+)\s*\(", r"\b([a-z][A-Za-z0-9_]+)\s*\(")
STATE_FOLDERS = (".factloom",)
DEBOUNCE_SECONDS, LOCK_STALE_SECONDS = 90, 900


def is_constraint() -> Column:
    return F.col("type").isin("invariant", "schema_fact") | ((F.col("type") == "decision") & F.col("decision_class").eqNullSafe(F.lit("constraint")))


def surface_title() -> Column:
    ref = F.when(F.col("source_ref") != "", F.col("source_ref"))
    return F.coalesce(F.when(F.col("tier") == "module", F.concat(F.lit("touches module "), ref)), F.concat(F.lit("touches "), ref), F.col("topic_key"))


def surfaces(hits: DataFrame, atoms: DataFrame) -> DataFrame:
    """Hits (id, trail) that name a piece of code: modules, or any glossary atoms where there is no module."""
    about = atoms.where(~F.col("archived")).select("id", "type", "tier", "source_ref", "topic_key")
    glossary = hits.select("id", "trail").join(about, "id").where("type = 'glossary'")
    module = F.max((F.col("tier") == "module").cast("int")).over(Window.partitionBy())  # hits of one query: thirty at most
    return glossary.withColumn("__any", module).where((F.col("__any") == 0) | (F.col("tier") == "module")).select("id", surface_title().alias("title"), "tier", "source_ref", "trail")


def plan(surface: DataFrame, atoms: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, per: int = 100) -> DataFrame:
    """A task per surface (id, title): constraints, owners, blocked_by (lists of struct id, type, topic, summary),
    blocked and place, blocked ones first, then by the strongest constraint, then by title.

    Of each surface the ``per`` heaviest live edges count. A closed decision that blocks it, and whatever
    contradicts it, blocks the task; each other atom stands in a list once.
    """
    standing = edges.where("valid_to is null and status = 'live'").select(F.col("id").alias("edge"), "src_id", "dst_id", "kind", "weight")
    sides = standing.select(F.col("dst_id").alias("id"), F.col("src_id").alias("other"), "kind", "weight", "edge").unionByName(standing.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "kind", "weight", "edge"))
    heaviest = Window.partitionBy("id").orderBy(F.desc("weight"), F.desc("edge"))
    near = surface.select("id").distinct().join(sides, "id").withColumn("n", F.row_number().over(heaviest)).where(F.col("n") <= per)
    about = atoms.where(~F.col("archived")).select(F.col("id").alias("other"), "type", "decision_class", "decision_status", "topic_key")
    texts = summaries.where("resolution = 50").select(F.col("atom_id").alias("other"), F.col("text").alias("summary")) if summaries is not None else None
    joined = near.join(about, "other")
    joined = joined.join(texts, "other", "left") if texts is not None else joined.withColumn("summary", F.lit(None).cast("string"))
    owner = (F.col("kind") == "OWNS") & (F.col("type") == "owner")
    decided = (F.col("kind") == "BLOCKS") & (F.col("type") == "decision")
    relevant = ~owner & (decided | (F.col("kind") == "CONTRADICTS") | is_constraint())
    blocking = (F.col("kind") == "CONTRADICTS") | ((F.col("kind") == "BLOCKS") & F.col("decision_status").eqNullSafe(F.lit("CLOSED")) & relevant)
    ref = F.struct(F.col("other").alias("id"), "type", F.col("topic_key").alias("topic"), F.coalesce("summary", "topic_key").alias("summary"))
    rank = F.when(relevant, F.when(F.col("type") == "schema_fact", 0).when(F.col("type") == "invariant", 1).otherwise(2))
    lists = joined.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(relevant, ref))).alias("constraints"),
        F.sort_array(F.collect_set(F.when(owner, ref))).alias("owners"),
        F.sort_array(F.collect_set(F.when(blocking, ref))).alias("blocked_by"),
        F.coalesce(F.min(rank), F.lit(2)).alias("best"),
    )
    none = F.array().cast(lists.schema["constraints"].dataType)
    tasks = surface.join(lists, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("constraints", "owners", "blocked_by")})
    tasks = tasks.withColumns({"blocked": F.size("blocked_by") > 0, "best": F.coalesce("best", F.lit(2))})
    place = Window.partitionBy().orderBy(F.desc("blocked"), "best", "title", "id")  # one query's surfaces
    return tasks.withColumn("place", F.row_number().over(place)).drop("best")


def plan_report(goal: str, tasks: DataFrame) -> DataFrame:
    """One row: the plan as JSON with its tasks in order, all constraints, owners and blocking facts once."""
    once = lambda column: F.array_distinct(F.flatten(F.transform("tasks", lambda t: t[column])))
    listed = tasks.agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "trail", "blocked", "constraints", "owners", "blocked_by"))).alias("tasks"))
    whole = F.struct(F.lit(goal).alias("goal"), "tasks", once("constraints").alias("constraints"), once("owners").alias("owners"), once("blocked_by").alias("blocking"))
    return listed.select(F.to_json(whole).alias("plan"))


def changed_symbols(diff: DataFrame) -> DataFrame:
    """name of symbols on added or removed lines (column ``line``): over two characters, not all capitals."""
    body = diff.where(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---)")).select(F.substring("line", 2, 1 << 20).alias("body"))
    found = F.concat(*[F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in CHANGED_SYMBOLS])
    names = body.select(F.explode(found).alias("name")).distinct()
    return names.where((F.length("name") > 2) & ~((F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Za-z]")))


def wanted_kinds(paths: list[str]) -> set[str] | None:
    """Kinds of finding that the changed files' suffixes allow; None: all."""
    known = [FINGERPRINTS[s] for p in paths if (s := "." + p.rsplit(".", 1)[-1].lower()) in FINGERPRINTS and "." in p]
    return {kind for kinds in known for kind in kinds} if known else None


def edge_cases(symbols: DataFrame, lines: DataFrame, mirrors: DataFrame, paths: list[str] = (), top: int = 5, most: int = 10) -> DataFrame:
    """kind, severity, claim, n_evidence of what a change to the symbols (name) may break.

    lines (path, line): where words stand; ``most`` lines of a symbol count as callers. mirrors (name, id).
    A symbol that no test file names is a test gap, one with mirrors may need its siblings changed, one named
    beside asserts puts an invariant at risk; a changed .sql file wants a migration. Most severe first.
    """
    # the symbols of a change are one array that every task holds; a line meets it as a whole, so that no row is made
    # of each of its words, with the line beside it
    asked = F.broadcast(symbols.agg(F.collect_set("name").alias("__asked")))
    words = F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))
    named = lines.crossJoin(asked).select("path", "line", F.explode(F.array_intersect(words, "__asked")).alias("name"))
    test = F.element_at(F.split("path", "/"), -1).rlike(r"^test|_test\.|\.test\.")
    nth = Window.partitionBy("name").orderBy("path", "line")
    callers = named.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= most)
    counts = callers.groupBy("name").agg(F.count(F.lit(1)).alias("callers"), F.count_if(F.lower("line").contains("assert")).alias("asserts"))
    tested = named.where(test).select("name").distinct().withColumn("tested", F.lit(True))
    twins = mirrors.groupBy("name").agg(F.count(F.lit(1)).alias("mirrors"))
    every = symbols.select("name").distinct().join(counts, "name", "left").join(tested, "name", "left").join(twins, "name", "left").na.fill(0, ["callers", "asserts", "mirrors"])
    quoted = F.concat(F.lit("`"), F.col("name"), F.lit("`"))
    gap = F.when(F.col("tested").isNull(), F.struct(F.lit("test_gap").alias("kind"), F.when(F.col("callers") >= 3, "med").otherwise("low").alias("severity"), F.concat(quoted, F.lit(" touched but no test file references it")).alias("claim"), F.least(F.col("callers"), F.lit(2)).alias("n_evidence")))
    twin = F.when(F.col("mirrors") > 0, F.struct(F.lit("cross_repo_impact").alias("kind"), F.lit("high").alias("severity"), F.concat(quoted, F.lit(" has MIRRORS edges — siblings may need matching changes")).alias("claim"), F.least(F.col("mirrors"), F.lit(3)).alias("n_evidence")))
    risk = F.when((F.col("callers") >= 2) & (F.col("asserts") > 0), F.struct(F.lit("invariant_risk").alias("kind"), F.lit("high").alias("severity"), F.concat(quoted, F.lit(" referenced near asserts ("), F.col("asserts").cast("string"), F.lit(" sites)")).alias("claim"), F.least(F.col("asserts") + 1, F.col("callers")).alias("n_evidence")))
    found = every.select(F.explode(F.filter(F.array(gap, twin, risk), lambda x: x.isNotNull())).alias("f")).select("f.*")
    kinds = wanted_kinds(list(paths))
    if kinds is not None:
        found = found.where(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    if kinds and "schema_migration" in kinds:
        n = min(3, sum(p.endswith(".sql") for p in paths))
        found = found.unionByName(found.sparkSession.createDataFrame([("schema_migration", "high", "staged diff includes a .sql file — schema migration required", n)], "kind string, severity string, claim string, n_evidence long"))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "med", 1).otherwise(2)
    return found.orderBy(order, F.desc("n_evidence"), "kind", "claim").limit(top)


def digest(atoms: DataFrame, summaries: DataFrame | None = None, k: int = 5) -> DataFrame:
    """id, type, topic_key, pinned, summary, place: the ``k`` most confident invariants, then closed constraints
    where these are fewer than ``k``; the pinned of them first."""
    live = temporal.live(atoms)
    best = lambda rows, part: rows.orderBy(F.desc("confidence"), "id").limit(k).withColumn("part", F.lit(part))
    first = best(live.where("type = 'invariant'"), 0)
    second = best(temporal.constraints(atoms).where("type = 'decision' and decision_status = 'CLOSED'"), 1)
    both = first.unionByName(second)
    enough = F.sum((F.col("part") == 0).cast("int")).over(Window.partitionBy()) >= k  # 2 k rows
    rows = both.withColumn("__enough", enough).where("part = 0 or not __enough")
    place = Window.partitionBy().orderBy(F.desc("pinned"), "part", F.desc("confidence"), "id")
    out = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("id", "type", "topic_key", "pinned", "place")
    if summaries is None:
        return out.orderBy("place")
    texts = summaries.where("resolution = 50").select(F.col("atom_id").alias("id"), F.col("text").alias("summary"))
    return out.join(texts, "id", "left").withColumn("summary", F.coalesce("summary", F.lit(""))).orderBy("place")


# --- drift --------------------------------------------------------------------------------------------


def countable_dirty(path: Column) -> Column:
    """Whether a changed path counts: not the engine's own state folders."""
    own = F.lit(False)
    for folder in STATE_FOLDERS:
        own = own | (path == folder) | path.startswith(folder + "/")
    return ~own


def drift(state: DataFrame, probes: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Per repo of ``state`` (repo_id, root_path, last_indexed_sha, last_indexed_at) how far the index is behind.

    probes (repo_id, root_exists, is_git, head_sha, commits_behind; null: unknown) say what the repository is like
    now; dirty (repo_id, path) what is changed and not committed. Adds never_indexed, unknown_base,
    indexed_without_head, behind, dirty, drifted and a description. Unknown never counts as zero commits: it is
    ``unknown_base``.
    """
    joined = state.join(probes, "repo_id", "left").withColumns({"root_exists": F.coalesce("root_exists", F.lit(False)), "is_git": F.coalesce("is_git", F.lit(False))})
    if dirty is not None:
        changed = dirty.where(countable_dirty(F.col("path"))).groupBy("repo_id").agg(F.count_distinct("path").alias("dirty"))
        joined = joined.join(changed, "repo_id", "left")
    joined = joined.withColumn("dirty", F.coalesce("dirty", F.lit(0)) if dirty is not None else F.lit(0))
    never = F.col("last_indexed_at").isNull()
    unknown = F.col("is_git") & F.col("last_indexed_sha").isNotNull() & F.col("commits_behind").isNull()
    headless = F.col("is_git") & ~never & F.col("last_indexed_sha").isNull() & F.col("head_sha").isNotNull()
    behind = F.coalesce("commits_behind", F.lit(0))
    drifted = F.col("root_exists") & F.col("is_git") & (never | unknown | headless | (behind > 0))
    said = (
        F.when(~F.col("root_exists"), "root no longer exists on disk")
        .when(~F.col("is_git"), "not a git repo — drift cannot be measured")
        .when(never, "never indexed")
        .when(unknown, F.concat(F.lit("indexed at "), F.substring("last_indexed_sha", 1, 7), F.lit(", which git cannot resolve")))
        .when(headless, "indexed before the repo's first commit — needs a full re-ingest")
        .when(behind == 0, "current with HEAD")
        .otherwise(F.concat(behind.cast("string"), F.lit(" commit(s) behind HEAD")))
    )
    return joined.select("repo_id", never.alias("never_indexed"), unknown.alias("unknown_base"), headless.alias("indexed_without_head"), behind.cast("long").alias("behind"), F.col("dirty").cast("long").alias("dirty"), drifted.alias("drifted"), said.alias("description"))


def drift_summary(drifts: DataFrame) -> DataFrame:
    """One row: behind, dirty, n_drifted and a summary, null where nothing drifted."""
    stale = F.col("drifted")
    n_behind, unknown, never = (F.count_if(stale & c) for c in (F.col("behind") > 0, F.col("unknown_base"), F.col("never_indexed")))
    total = F.coalesce(F.sum(F.when(stale, F.col("behind"))), F.lit(0))
    counts = drifts.agg(F.coalesce(F.sum("behind"), F.lit(0)).alias("behind"), F.coalesce(F.sum("dirty"), F.lit(0)).alias("dirty"), F.count_if(stale).alias("n_drifted"), total.alias("t"), n_behind.alias("b"), unknown.alias("u"), never.alias("v"))
    parts = F.array(
        F.when(F.col("b") > 0, F.concat(F.lit("index is "), F.col("t").cast("string"), F.lit(" commit(s) behind HEAD across "), F.col("b").cast("string"), F.when(F.col("b") == 1, " root").otherwise(" roots"))),
        F.when(F.col("u") > 0, F.concat(F.col("u").cast("string"), F.lit(" root(s) indexed against a sha git cannot resolve"))),
        F.when(F.col("v") > 0, F.concat(F.col("v").cast("string"), F.lit(" root(s) never indexed"))),
    )
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")
    return counts.select("behind", "dirty", "n_drifted", F.when((F.col("n_drifted") > 0) & (text != ""), text).alias("summary"))


def pulse(atoms: DataFrame, candidates: DataFrame, drifts: DataFrame, now: int) -> DataFrame:
    """One row of counts for a status line: atoms, stale, to_review, behind."""
    live = temporal.live(atoms)
    kind = F.coalesce("liveness_kind", F.lit("none"))
    late = (kind != "none") & (F.col("liveness_last_ok").isNull() | (F.col("liveness_last_ok") < now - 86_400))
    a = live.agg(F.count(F.lit(1)).alias("atoms"), F.count_if(late).alias("stale"))
    b = candidates.agg(F.count_if(F.col("status") == "pending").alias("to_review"))
    c = drifts.agg(F.coalesce(F.sum("behind"), F.lit(0)).alias("behind"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def debounced(events: DataFrame, *, key: list[str], at: str, order: list[str], gap: int = DEBOUNCE_SECONDS) -> DataFrame:
    """Adds ``burst``, the number of the burst that an event belongs to: a new one after ``gap`` seconds of silence.

    Per key, a gap is seen from the event before; numbers are running sums over days first, then inside a day,
    so that a key of very many events is spread over tasks.
    """
    day = F.floor(F.col(at) / 86_400)
    rows = events.withColumn("__day", day)
    inside = Window.partitionBy(*key, "__day").orderBy(at, *order)
    last = rows.groupBy(*key, "__day").agg(F.max(at).alias("__last"))
    along = Window.partitionBy(*key).orderBy("__day")
    before = last.select(*key, "__day", F.lag("__last").over(along).alias("__before"))
    joined = rows.join(before, [*key, "__day"])
    previous = F.coalesce(F.lag(at).over(inside), F.col("__before"))
    opened = joined.withColumn("__opens", F.when(previous.isNull() | (F.col(at) - previous >= gap), 1).otherwise(0))
    sums = opened.groupBy(*key, "__day").agg(F.sum("__opens").alias("__n"))
    first = sums.select(*key, "__day", F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    numbered = opened.join(first, [*key, "__day"]).withColumn("burst", F.col("__first") + F.sum("__opens").over(inside))
    return numbered.drop("__day", "__before", "__opens", "__first")


def changes_of(events: DataFrame, *, key: list[str], signature: str, order: list[str]) -> DataFrame:
    """Events whose signature differs from that of the event before: a change is spoken of once."""
    along = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("__before", F.lag(signature).over(along)).where(~F.col("__before").eqNullSafe(F.col(signature))).drop("__before")


def recent(messages: DataFrame, *, key: list[str], order: list[str], most: int = 40) -> DataFrame:
    """The last ``most`` messages of each key."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def heartbeats(events: DataFrame, *, event: str, at: str, outcome: str, order: list[str]) -> DataFrame:
    """event, invocations, last_at, last_outcome."""
    return events.groupBy(F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("invocations"), F.max(at).alias("last_at"), F.max_by(outcome, F.struct(at, *order)).alias("last_outcome"))


def pulse_line(pulse_row: DataFrame) -> DataFrame:
    """The counts as one line; parts that are zero are left out."""
    part = lambda column, suffix: F.when(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(suffix)))
    parts = F.array(F.concat(F.col("atoms").cast("string"), F.lit(" facts")), part("stale", " stale"), part("to_review", " to review"), part("behind", " behind"))
    return pulse_row.select(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ").alias("line"))


def title_slug(goal: str, spark) -> str:
    return spark.range(1).select(X.slug(F.lit(goal))).first()[0]
