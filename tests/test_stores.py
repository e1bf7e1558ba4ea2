"""Ingestion, sync, planning, drift, sweeps and streams on literal rows."""

import pytest
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import embed
from factloom.operators import discovery, health, liveness, planning, sync, temporal
from factloom.sources import ingest, jsonl, store
from factloom.streaming import streams


def frame(spark, schema, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in rows], schema)


ATOM = {"archived": False, "pinned": False, "confidence": 1.0, "type": "glossary", "workspace_id": "w", "asserted_at": 100, "valid_from": 100, "created_at": 100, "updated_at": 100, "source_kind": "readme", "tier": "symbol"}


def tables(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in model.TABLES.items()}


def test_ingest_run_and_second_run(spark):
    rows = [("README.md", "# Loom\n\nA store of facts, see src/a.py.\n"), ("src/a.py", "def alpha():\n    pass\n"), ("src/b.py", "class Beta:\n    pass\n"), ("db/x.sql", "CREATE TABLE t (id int primary key);"), ("package.json", "{")]
    files = spark.createDataFrame(rows, "path string, text string")
    log = spark.createDataFrame([(f"{i:040d}", 10 + i, "ann", f"change {i}", "") for i in range(4)], "sha string, ts long, author string, subject string, body string")
    touched = spark.createDataFrame([(f"{i:040d}", p) for i in range(4) for p in ("src/a.py", "src/b.py")], "sha string, path string")
    source = ingest.Input(files, log, touched, now=1000)
    out, report, results = ingest.ingested(tables(spark), source)
    status = {r.name: (r.status, r.atoms) for r in report.collect()}
    assert status == {"readme": ("ok", 1), "manifest": ("ok", 0), "schema": ("ok", 1), "invariants": ("ok", 1), "git": ("ok", 4), "symbols": ("ok", 2), "modules": ("ok", 2), "owners": ("ok", 1)}
    topics = {r.topic_key for r in temporal.live(out["atoms"]).collect()}
    assert {"doc:README.md", "table:t", "invariant:t.id.pk", "symbol:src/a.py:alpha", "module:src", "module:db", "owner:src:ann", "commit:0000000"} <= topics
    kinds = {(r.kind, r.n) for r in out["edges"].groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k for k, _ in kinds} == {"ROLLS_UP", "OWNS", "CO_CHANGED", "REFERENCES"}
    again, _, _ = ingest.ingested(out, source)
    assert again["atoms"].count() == out["atoms"].count() and again["edges"].count() == out["edges"].count() and again["atom_summaries"].count() == out["atom_summaries"].count()
    gone = ingest.Input(files.where("path <> 'src/b.py'"), log, touched, deleted=spark.createDataFrame([("src/b.py",)], "path string"), now=2000)
    later, _, _ = ingest.ingested(out, gone)
    assert {r.topic_key for r in later["atoms"].where("valid_to = 2000").collect()} >= {"symbol:src/b.py:Beta"}
    late, _, results = ingest.ingested(tables(spark), source, budget_seconds=0.0)
    assert all(r.deferred for r in results.values()) and late["atoms"].count() == 0
    state = frame(spark, model.REPO_STATE, [{"repo_id": "repo", "root_path": "/x", "last_indexed_sha": "old"}])
    assert ingest.indexed(state, source, results, "new").first().last_indexed_sha == "old"
    assert {n: r.status() for n, r in ingest.run(ingest.Input(files), ["git", "nope"]).items()} == {"git": "skip: not a git repository", "nope": "skip: unknown ingester: nope"}


def test_sync_debounce_lock_and_embeddings(spark):
    assert ingest.due(0, 50) == 0 and ingest.due(40, 50) == 80 and ingest.due(40, 200) == 0
    assert ingest.may_lock(None, 5) and not ingest.may_lock(1, 900) and ingest.may_lock(1, 902)
    source = ingest.Input(spark.createDataFrame([("README.md", "# T\n\nwords here")], "path string, text string"), now=1000)
    kept = {n: v for n, v in tables(spark).items() if n != "repo_state"}
    for how, want in (({"drifted": False, "last_sync": 0, "held_since": None}, "current"), ({"drifted": True, "last_sync": 990, "held_since": None}, "debounced"), ({"drifted": True, "last_sync": 0, "held_since": 990}, "locked")):
        assert ingest.synced(kept, source, **how)[1] == want
    out, said = ingest.synced(kept, source, drifted=True, last_sync=0, held_since=None, embed=lambda rows: embed.embed_with(rows, embed.HashEmbedder()))
    assert said == "synced" and [(r.model, len(r.vector)) for r in out["atom_vectors"].collect()] == [("hash-3gram-v1", 384)]
    status = store.embed_status(out["atoms"], out["atom_summaries"], out["atom_vectors"], "hash-3gram-v1").first()
    assert (status.live, status.embedded, status.unembedded, status.mismatch) == (1, 1, 0, False)
    assert store.pending_embeddings(out["atoms"], out["atom_summaries"], out["atom_vectors"], "hash-3gram-v1").count() == 0


def test_merge_is_commutative_associative_idempotent(spark):
    def side(close, pinned, kind, refs, conf):
        rows = [ATOM | {"id": "a", "topic_key": "t", "valid_to": close, "superseded_by": None if close is None else f"s{conf}", "pinned": pinned, "liveness_kind": kind, "liveness_pattern": f"p{conf}", "valid_in_refs": refs, "confidence": conf}]
        edge = {"src_id": "a", "dst_id": "b", "kind": "REFERENCES", "valid_from": 1, "directed": True, "weight": conf, "confidence": conf, "status": "rejected" if pinned else "live", "source": "manual", "created_at": 5}
        return {"atoms": frame(spark, model.ATOMS, rows), "atom_summaries": frame(spark, model.SUMMARIES, [{"atom_id": "a", "resolution": 10, "text": "w " * int(conf * 20)}]), "edges": frame(spark, model.EDGES, [edge]).drop("id"), "edge_evidence": spark.createDataFrame([("a", "b", "REFERENCES", 1, "k", f"p{conf}", 1)], "edge_src string, edge_dst string, edge_kind string, edge_valid_from long, kind string, payload string, created_at long")}

    a, b, c = side(None, False, None, ["x"], 0.2), side(9, True, "regex", ["y"], 0.5), side(9, False, "ast", None, 0.9)
    plain = lambda t: {n: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for n, df in t.items()}
    one = plain(sync.merged(sync.merged(a, b), c))
    assert one == plain(sync.merged(c, sync.merged(b, a))) == plain(sync.merged(sync.merged(a, b), sync.merged(c, a)))
    got = sync.merged(sync.merged(a, b), c)["atoms"].first()
    assert (got.valid_to, got.superseded_by, got.pinned, got.liveness_kind, got.valid_in_refs, got.confidence) == (9, "s0.5", True, "ast", ["x", "y"], 0.2)


def test_import_counts_orphans_and_reconcile(spark):
    local, new = tables(spark), tables(spark)
    local["atoms"] = frame(spark, model.ATOMS, [ATOM | {"id": "a", "topic_key": "t", "valid_from": 5}, ATOM | {"id": "k", "topic_key": "u"}])
    new["atoms"] = frame(spark, model.ATOMS, [ATOM | {"id": "b", "topic_key": "t", "valid_from": 7}, ATOM | {"id": "k", "topic_key": "u"}, ATOM | {"id": "a", "topic_key": "t", "valid_from": 5, "pinned": True}])
    new["atom_summaries"] = frame(spark, model.SUMMARIES, [{"atom_id": "b", "resolution": 10, "text": "x"}, {"atom_id": "gone", "resolution": 10, "text": "x"}])
    new["edges"] = frame(spark, model.EDGES, [{"src_id": "a", "dst_id": "b", "kind": "OWNS", "valid_from": 1, "weight": 1.0, "confidence": 1.0, "status": "live"}, {"src_id": "a", "dst_id": "gone", "kind": "OWNS", "valid_from": 1, "weight": 1.0, "confidence": 1.0, "status": "live"}])
    names = "edge_src string, edge_dst string, edge_kind string, edge_valid_from long, kind string, payload string, created_at long"
    local["edge_evidence"] = spark.createDataFrame([("a", "b", "OWNS", 1, "k", "p", 3)], names)
    new["edge_evidence"] = spark.createDataFrame([("a", "b", "OWNS", 1, "k", "p", 9), ("a", "gone", "OWNS", 1, "k", "p", 9)], names)
    out, counts, conflicts = sync.imported(local, new, 100)
    assert {tuple(r) for r in counts.collect()} == {("atoms", 1, 1, 1), ("edges", 1, 0, 0)}
    assert [(r.topic_key, r.kept, r.closed) for r in conflicts.collect()] == [("t", "b", "a")]
    assert {(r.id, r.valid_to, r.superseded_by) for r in out["atoms"].collect()} == {("a", 100, "b"), ("b", None, None), ("k", None, None)}
    assert out["atom_summaries"].count() == 1 and out["edges"].count() == 1 and [r.created_at for r in out["edge_evidence"].collect()] == [3]
    assert [(r.src_id, r.dst_id) for r in sync.conflict_edges(conflicts).collect()] == [("a", "b")]


def test_merge_of_lines(spark):
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    ours = lines('{"_table":"atom_summaries","atom_id":"a","resolution":10,"text":"one two"}', '{"_table":"jobs","id":1}', '{"_table":"atoms","id":"a","ty')
    theirs = lines('{"_table":"atom_summaries","atom_id":"a","resolution":10,"text":"one two three"}')
    got = [r.line for r in sync.merged_lines(ours, theirs).collect()]
    assert got == ['{"_table":"atom_summaries","atom_id":"a","resolution":10,"text":"one two three","token_count":4}']
    assert got == [r.line for r in sync.merged_lines(theirs, ours).collect()]


def test_validation_history_and_supersede(spark):
    rows = [ATOM | {"id": "1", "topic_key": "t"}, ATOM | {"id": "2", "confidence": 1.5}, ATOM | {"id": "3", "type": "decision"}, ATOM | {"id": "4", "type": "decision", "decision_status": "OPEN", "source_kind": "commit"}, ATOM | {"id": "5", "type": "thing"}, ATOM | {"id": "6", "decision_status": "OPEN"}]
    good, bad = temporal.validated(frame(spark, model.ATOMS, rows))
    assert {(r.id, r.decision_class) for r in good.collect()} == {("1", None), ("4", "change")}
    assert {r.id: r.error for r in bad.collect()} == {"2": "confidence outside [0, 1]", "3": "decision without status", "5": "unknown type", "6": "status of no decision"}
    atoms = frame(spark, model.ATOMS, [ATOM | {"id": "a"}, ATOM | {"id": "b", "valid_to": 7}])
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "zz")], "old string, new string")
    assert {(r.id, r.valid_to, r.superseded_by) for r in temporal.superseded(atoms, pairs, 9).collect()} == {("a", 9, "b"), ("b", 7, "a")}
    assert [r.id for r in temporal.missing(pairs, atoms).collect()] == ["zz"]
    with pytest.raises(ValueError):
        temporal.query_atoms(atoms, order_by="id DESC")
    with pytest.raises(ValueError):
        temporal.query_atoms(atoms, limit=0)
    with pytest.raises(store.Ambiguous):
        store.resolve(frame(spark, model.ATOMS, [ATOM | {"id": i, "topic_key": "t"} for i in "xy"]), "t")


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("# keep\n[retrieval]\nseed_k = 4 # k\nmin_relevance = 0.1\n[guard]\nenabled = false\n[capture]\nexclude_terms = ['ann']\n")
    store.set_min_relevance(str(path), 0.25)
    assert path.read_text() == "# keep\n[retrieval]\nseed_k = 4 # k\nmin_relevance = 0.25\n[guard]\nenabled = false\n[capture]\nexclude_terms = ['ann']\n"
    c = store.Config.load(str(path))
    assert (c.min_relevance, c.seed_k, c.policy().enabled, c.policy().exclude_terms) == (0.25, 4, False, ("ann",))
    store.set_min_relevance(str(tmp_path / "new.toml"), 0.5)
    assert store.Config.load(str(tmp_path / "new.toml")).min_relevance == 0.5


def test_plan_and_edge_cases(spark):
    about = [("m", "glossary", None, None, "module"), ("d", "decision", "CLOSED", "constraint", "symbol"), ("o", "decision", "OPEN", "constraint", "symbol"), ("w", "owner", None, None, "symbol"), ("i", "invariant", None, None, "symbol"), ("n", "glossary", None, None, "module"), ("c", "convention", None, None, "symbol")]
    atoms = frame(spark, model.ATOMS, [ATOM | {"id": i, "type": t, "decision_status": s, "decision_class": c, "tier": tier, "topic_key": "t:" + i, "source_ref": i} for i, t, s, c, tier in about])
    link = lambda k, a, b, kind: {"id": k, "src_id": a, "dst_id": b, "kind": kind, "weight": 1.0, "confidence": 1.0, "status": "live"}
    edges = frame(spark, model.EDGES, [link("1", "d", "m", "BLOCKS"), link("2", "w", "m", "OWNS"), link("3", "i", "n", "REFERENCES"), link("4", "o", "n", "BLOCKS"), link("5", "c", "n", "REFERENCES"), link("6", "d", "m", "REFERENCES")])
    hits = spark.createDataFrame([("m", "seed"), ("n", "seed"), ("c", "seed")], "id string, trail string")
    tasks = planning.plan(planning.surfaces(hits, atoms), atoms, edges)
    ids = lambda xs: [x.id for x in xs]
    assert [(r.id, r.title, r.blocked, ids(r.constraints), ids(r.owners), ids(r.blocked_by)) for r in tasks.orderBy("place").collect()] == [("m", "touches module m", True, ["d"], ["w"], ["d"]), ("n", "touches module n", False, ["i", "o"], [], [])]
    report = planning.plan_report("do it", tasks)
    new, texts = store.persisted_plan(atoms, spark.createDataFrame([], model.SUMMARIES), report, "Do it, now!", 50)
    assert new.where("topic_key = 'plan:do-it-now' and decision_status = 'CLOSED' and decision_class = 'change'").count() == 1 and texts.count() == 3
    diff = spark.createDataFrame([("+def alpha(x):",), ("- Beta(1)",), ("+++ b/gamma(.py",), (" delta()",), ("+IF(x)",)], "line string")
    names = planning.changed_symbols(diff)
    assert {r.name for r in names.collect()} == {"alpha", "Beta"}
    lines = spark.createDataFrame([("src/a.py", "alpha(1)"), ("src/b.py", "assert alpha(2)"), ("src/c.py", "alpha"), ("tests/test_b.py", "Beta()")], "path string, line string")
    found = planning.edge_cases(names, lines, spark.createDataFrame([("Beta", "A1")], "name string, id string")).collect()
    assert [(r.kind, r.severity, r.n_evidence) for r in found] == [("invariant_risk", "high", 2), ("cross_repo_impact", "high", 1), ("test_gap", "med", 2)]
    assert [r.kind for r in planning.edge_cases(names, lines, spark.createDataFrame([], "name string, id string"), ["x.sql"]).collect()] == ["invariant_risk", "schema_migration"]
    assert planning.edge_cases(names, lines, spark.createDataFrame([], "name string, id string"), ["x.md"]).count() == 0


def test_drift_states(spark):
    rows = [("cur", "s", 1, True, True, "s", 0), ("two", "s", 1, True, True, "h", 2), ("lost", "s", 1, True, True, "h", None), ("new", None, None, True, True, "h", None), ("first", None, 1, True, True, "h", None), ("plain", "s", 1, True, False, None, None), ("gone", "s", 1, False, False, None, None)]
    state = spark.createDataFrame([(r, "/x", s, a) for r, s, a, *_ in rows], "repo_id string, root_path string, last_indexed_sha string, last_indexed_at long")
    probes = spark.createDataFrame([(r, e, g, h, b) for r, _, _, e, g, h, b in rows], "repo_id string, root_exists boolean, is_git boolean, head_sha string, commits_behind long")
    dirty = spark.createDataFrame([("cur", "a"), ("cur", ".factloom/x"), ("cur", "a")], "repo_id string, path string")
    got = planning.drift(state, probes, dirty)
    assert {r.repo_id: (r.drifted, r.description) for r in got.collect()} == {
        "cur": (False, "current with HEAD"), "two": (True, "2 commit(s) behind HEAD"), "lost": (True, "indexed at s, which git cannot resolve"), "new": (True, "never indexed"),
        "first": (True, "indexed before the repo's first commit — needs a full re-ingest"), "plain": (False, "not a git repo — drift cannot be measured"), "gone": (False, "root no longer exists on disk"),
    }
    s = planning.drift_summary(got).first()
    assert (s.behind, s.dirty, s.summary) == (2, 1, "index is 2 commit(s) behind HEAD across 1 root; 1 root(s) indexed against a sha git cannot resolve; 1 root(s) never indexed")
    log = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sha string, ts long")
    assert store.commits_behind(log, "a") == 2 and store.commits_behind(log, "zz") is None and store.commits_behind(log, None) is None and store.head_sha(log) == "c"
    touched = spark.createDataFrame([("b", "x"), ("c", "y"), ("a", "z")], "sha string, path string")
    tracked = spark.createDataFrame([("x",)], "path string")
    assert {r.path for r in store.changed_since(log, touched, "a").collect()} == {"x", "y"} and [r.path for r in store.deleted_since(log, touched, "a", tracked).collect()] == ["y"] and store.deleted_since(log, touched, "q", tracked) is None


def test_reap_directories_and_unknown(spark):
    rows = [("f", "symbol:d/x.py:g", "d/x.py:12", "manifest"), ("m", "module:d", "d", "manual"), ("k", "module:e", "e", "manual"), ("c", "commit:1", "d/x.py", "commit"), ("o", "owner:d:ann", "d", "commit")]
    atoms = frame(spark, model.ATOMS, [ATOM | {"id": i, "topic_key": t, "source_ref": r, "source_kind": s} for i, t, r, s in rows])
    deleted = spark.createDataFrame([("d/x.py",), ("e/y.py",)], "path string")
    tracked = spark.createDataFrame([("e/z.py",)], "path string")
    assert {r.id for r in discovery.reaped(atoms, deleted, tracked, 9).where("valid_to = 9").collect()} == {"f", "m", "o"}
    assert discovery.reaped(atoms, None, tracked, 9).where("valid_to is not null").count() == 0


def test_sweep_until_clear(spark):
    rows = [ATOM | {"id": f"{i}", "liveness_kind": "regex", "liveness_target": "f", "liveness_pattern": "ok" if i % 2 else "no"} for i in range(7)]
    swept, runs = liveness.swept(frame(spark, model.ATOMS, rows), spark.createDataFrame([("f", "ok")], "path string, text string"), now=10**6, batch=3)
    assert {r.id for r in swept.where("liveness_last_ok = 1000000").collect()} == {"1", "3", "5"} and runs == 3


def test_debounce_by_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = sorted((rng.choice("ab"), rng.randrange(0, 400_000), i) for i in range(150))
    want, last, burst = {}, {}, {}
    for k, at, i in rows:
        if k not in last or at - last[k] >= 90:
            burst[k] = burst.get(k, 0) + 1
        last[k], want[i] = at, (k, burst[k])
    got = planning.debounced(spark.createDataFrame(rows, "k string, at long, id int"), key=["k"], at="at", order=["id"]).collect()
    assert {r.id: (r.k, r.burst) for r in got} == want


def test_doctor(spark):
    t = tables(spark)
    t["schema_version"] = spark.createDataFrame([(7,)], "version int")
    t["atoms"] = frame(spark, model.ATOMS, [ATOM | {"id": str(i), "topic_key": "joe@corp.org" if i == 0 else "t", "liveness_kind": "regex"} for i in range(25)])
    found = {r["name"]: (r.severity, r.summary) for r in health.report(spark, t, 10**6).collect()}
    assert len(found) == 22 and found["schema.version"] == ("ok", "v7") and found["edges.density"][0] == "fail" and found["guard.store"] == ("warn", "1 live atom(s) hold secrets or personal data")
    assert found["liveness.freshness"] == ("fail", "25/25 predicates stale (100%)") and found["hooks.heartbeat"] == ("warn", "hooks never invoked") and found["hooks.git"] == ("fail", "check COULD NOT RUN: no hooks")
    assert health.report(spark, t, 10**6, quick=True).count() == 21
    log = [{"id": i, "ts": i, "atoms_returned": ["x"] if i % 4 else [], "n_suppressed": 0 if i % 4 else 2, "top_relevance": 0.24 if i % 8 else 0.1, "min_relevance": 0.25} for i in range(40)]
    c = health.calibration_counts(frame(spark, model.RETRIEVAL_LOG, log)).first()
    assert (c.n, c.silenced, c.gated, c.near_miss, c.floor) == (40, 10, 10, 5, 0.25)


def test_streams_dispatch_and_captures(spark, tmp_path):
    rows = [("prompt", 1), ("stop", 2), ("odd", 3), ("bad", 4)]
    spark.createDataFrame(rows, "event string, n int").write.parquet(str(tmp_path / "in"))
    seen = []
    run = streams.dispatched({"prompt": lambda df: seen.append(df.count()), "bad": lambda df: 1 / 0, "never": lambda df: seen.append("x")})
    q = spark.readStream.schema("event string, n int").parquet(str(tmp_path / "in")).writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert seen == [1] and {(k, o) for _, k, o in run.outcomes} == {("prompt", "ok"), ("bad", "error: ZeroDivisionError"), ("odd", "ignored"), ("stop", "ignored")}
    messages = spark.createDataFrame([("s", "we must always tag every release")], "session_id string, text string")
    messages.write.parquet(str(tmp_path / "m"))
    found = streams.captures(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "m"))).writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    found.awaitTermination(60)
    assert [(r.unit, r.score) for r in spark.table("found").collect()] == [("we must always tag every release", 5)]


def test_sharded_export_of_changed_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    old = spark.createDataFrame([("aa1", 1), ("bb1", 1)], "id string, v int")
    jsonl.export_sharded(old, "atoms", path)
    new = old.withColumn("v", F.when(F.col("id") == "aa1", 2).otherwise(F.col("v")))
    changed = jsonl.changed_shards(jsonl.sharded_lines(new, "atoms"), jsonl.sharded_lines(old, "atoms"))
    assert [r.shard for r in changed.collect()] == ["aa"]
    jsonl.export_sharded(new, "atoms", path, only=changed)
    assert sorted(r.value for r in spark.read.text(path, recursiveFileLookup=True).collect()) == ['{"_table":"atoms","id":"aa1","v":2}', '{"_table":"atoms","id":"bb1","v":1}']
    lines = spark.createDataFrame([('{"session_id":"s"}',), ("nope",)], "value string")
    assert [r.session_id for r in jsonl.hook_payload(lines).collect()] == ["s", None]


def test_resolve_topic_without_unique_topic(spark, tmp_path):
    import duckdb

    from factloom.plans import stores
    from factloom.plans.registry import QUERIES, SQL

    assert stores
    for name, keys, want in (("none", [1, 501], []), ("one", [1, 2, 501], ["A2"])):
        folder = tmp_path / name
        spark.createDataFrame([(k, 5, "STEEL", "Brand#11") for k in keys], "p_partkey long, p_size int, p_type string, p_brand string").write.parquet(str(folder / "part.parquet"))
        twin = duckdb.connect()
        twin.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
        assert [r[0] for r in twin.execute(SQL["resolve_topic"]).fetchall()] == want
        assert [r.id for r in QUERIES["resolve_topic"](spark, str(folder)).collect()] == want


def test_module_edges_deal_atoms_by_edges(spark, monkeypatch):
    modules = spark.createDataFrame([("M1", "d"), ("M2", "d"), ("M3", "d/e"), ("M4", "none")], "id string, directory string")
    atoms = spark.createDataFrame([(f"A{i}", "d/e/f.py:7" if i % 3 == 0 else "d", None, False, "symbol") for i in range(9)], "id string, source_ref string, valid_to long, archived boolean, tier string")
    want = {(f"A{i}", m) for i in range(9) for m in (("M1", "M2", "M3") if i % 3 == 0 else ("M1", "M2"))}
    for held, edges in ((100, 2), (100, 5_000_000), (0, 5_000_000)):
        monkeypatch.setattr(discovery, "HELD_MODULES", held, raising=False)
        monkeypatch.setattr(discovery, "TASK_EDGES", edges, raising=False)
        found = discovery.module_edges(modules, atoms)
        assert sorted((r.src_id, r.dst_id) for r in found.collect()) == sorted(want)
        if edges == 2:  # one directory's edges are made by more than one task
            assert found.rdd.getNumPartitions() > 1 and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_edge_cases_take_lines_whole(spark):
    lines = spark.createDataFrame([("src/a.py", "alpha alpha beta"), ("src/b.py", "assert alpha(1)"), ("src/test_c.py", "gamma"), ("src/d.py", None)], "path string, line string")
    symbols = spark.createDataFrame([("alpha",), ("gamma",), ("alpha",)], "name string")
    cases = planning.edge_cases(symbols, lines, spark.createDataFrame([], "name string, id string"))
    assert "LeftSemi" not in cases._jdf.queryExecution().toString()  # no row of each word with its line
    assert {(r.kind, r.severity, r.n_evidence) for r in cases.collect()} == {("invariant_risk", "high", 2), ("test_gap", "low", 2)}
