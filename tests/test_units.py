"""Sources, liveness, planning, merging and streams on literal rows."""

import json

import numpy as np
from pyspark.sql import functions as F

from factloom import model
from factloom.operators import graph, liveness, merge, near, retrieval, temporal
from factloom.sources import files, jsonl, store
from factloom.streaming import streams


def said(facts):
    return [(f.kind, f.topic, f.claim) for f in facts]


def test_parsers():
    got = files.pyproject("pyproject.toml", '[project]\ndependencies=["a>=1","b[x]; python_version>3"]\nrequires-python=">=3.11"\n[project.optional-dependencies]\nt=["c"]\n[project.scripts]\nrun="m:f"')
    assert [(f.topic, f.claim) for f in got] == [
        ("runtime:python", "python runtime constraint: >=3.11 (declared in pyproject.toml)."), ("dep:pypi:a", "pypi dependency a pinned at >=1 (from pyproject.toml)."), ("dep:pypi:b", "pypi dependency b pinned at [x]; python_version>3 (from pyproject.toml)."),
        ("dep:pypi:c", "pypi dependency c pinned at * (extra:t) (from pyproject.toml)."), ("script:pypi:run", "pypi script `run` runs: m:f"),
    ]
    assert [f.pattern for f in files.package_json("package.json", '{"dependencies":{"@s/x":"^1"},"devDependencies":{"y":"2"},"engines":{"node":">=18"}}')] == [">=18", r"(?<![\w@])@s/x\b", r"\by\b"]
    assert [f.topic for f in files.go_mod("g", "module m\ngo 1.22\nrequire (\n a.b/c v1 // x\n)\nrequire d v2")] == ["runtime:go", "dep:gomod:a.b/c", "dep:gomod:d"]
    assert [f.topic for f in files.pubspec_yaml("p", "environment:\n  sdk: '>=3'\ndependencies:\n  http: ^1.0\nname: x")] == ["runtime:dart", "dep:pub:http"]
    assert [(f.topic, f.line) for f in files.requirements_txt("r", "# c\n-r x\na==1\n")] == [("dep:pypi:a", 3)]
    assert [f.claim for f in files.cargo_toml("c", '[package]\nedition="2021"\n[dependencies]\nx="1"\n[dev-dependencies]\ny={version="2"}')] == ["rust runtime constraint: 2021 (declared in c).", "cargo dependency x pinned at 1 (from c).", 'cargo dependency y pinned at {"version": "2"} (dev-dependencies) (from c).']
    ddl = "CREATE TABLE IF NOT EXISTS s.t (id int primary key, n varchar(9) not null check (n in ('a,b', f(1,2))), u int references v(w), foreign key (id) references u(id));"
    assert said(files.schema_sql("d", ddl)) == [("schema_fact", "table:t", "Table `t` defined in d with 3 columns: id int, n varchar(9), u int.")]
    assert [(f.topic, f.claim) for f in files.invariants("d", ddl)] == [
        ("invariant:t.id.pk", "`t` is keyed by `id`."), ("invariant:t.n.not_null", "`t.n` is required — NOT NULL is enforced by the schema."),
        ("invariant:t.n.check", "`t.n` is constrained to n in ('a,b', f(1,2)) — enforced by a CHECK."), ("invariant:t.u.fk", "`t.u` must reference `v(w)` — a foreign key enforces it."),
    ]
    assert files.declared("a.py", "def f():\n  pass\nclass G: pass\ndef f(): pass") == [("f", 1), ("G", 3)] and files.declared("a.swift", "public final class P {}") == [("P", 1)] and files.declared("a.rb", "def f") == []
    assert said(files.readme("README.md", "x\n# Title\n\nfirst para\nmore\n\nsecond")) == [("glossary", "doc:README.md", "first para more")] and files.readme("docs/README.md", "# T") == []


def test_files_and_skips(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules" / "package.json").write_text("{}")
    (tmp_path / "a" / "package.json").write_text('{"dependencies":{"x":"1"}}')
    (tmp_path / "package.json").write_text("{")
    rows = files.files(spark, str(tmp_path), "package.json")
    assert {(r.path, r.kind) for r in files.parsed(rows, files.manifest).collect()} == {("a/package.json", "dependency"), ("package.json", "skipped")}
    paths = spark.createDataFrame([("a/x.py",), ("b/readme.md",), (".github/x.py",), ("top.py",)], "path string")
    assert [r.module for r in files.modules(paths).collect()] == ["a"]


def atoms(spark, rows):
    names = ["id", "type", "topic_key", "workspace_id", "valid_from", "valid_to", "asserted_at", "superseded_by", "archived", "pinned", "confidence", "decision_status", "decision_class", "source_kind", "source_ref", "liveness_kind", "liveness_target", "liveness_pattern", "liveness_last_ok"]
    full = [{f.name: r.get(f.name) for f in model.ATOMS if f.name in names} for r in rows]
    return spark.createDataFrame(full, model.T.StructType([f for f in model.ATOMS if f.name in names]))


def test_assert_closes_and_ignores_repeats(spark):
    base = {"type": "decision", "topic_key": "t", "workspace_id": "w", "archived": False}
    old = atoms(spark, [base | {"id": "a", "asserted_at": 1, "valid_from": 1}])
    new = atoms(spark, [base | {"id": "a", "asserted_at": 2, "valid_from": 2}, base | {"id": "b", "asserted_at": 3, "valid_from": 3}, base | {"id": "c", "asserted_at": 4, "valid_from": 4}])
    got = {(r.id, r.valid_to, r.superseded_by) for r in temporal.assert_facts(old, new).collect()}
    assert got == {("a", 3, "b"), ("b", 4, "c"), ("c", None, None)}


def test_liveness_states(spark):
    base = {"archived": False, "type": "x", "topic_key": "t"}
    rows = [base | {"id": i, "liveness_kind": k, "liveness_target": t, "liveness_pattern": p} for i, k, t, p in [("1", "regex", "f", "^b"), ("2", "regex", "f", "zz"), ("3", "regex", "gone", "."), ("4", "regex", "../f", "."), ("5", "regex", "f", "("), ("6", "ast", "f", "g"), ("7", None, None, None)]]
    out = liveness.checked(atoms(spark, rows), spark.createDataFrame([("f", "a\nb")], "path string, text string"), now=9)
    assert {r.id: r.state for r in out.collect()} == {"1": "verified", "2": "failed", "3": "failed", "4": "failed", "5": "failed", "6": "unverifiable", "7": "none"}
    declared = liveness.checked(atoms(spark, rows), spark.createDataFrame([("f", "a")], "path string, text string"), spark.createDataFrame([("f", "g")], "path string, name string"), now=9)
    assert {r.state for r in declared.where("id = '6'").collect()} == {"verified"}
    assert liveness.sql_holds(spark, "select 1") == "verified" and liveness.sql_holds(spark, "select 1; drop table x") == "failed" and liveness.sql_holds(spark, "select * from nowhere") == "failed"


def test_merge_is_commutative_and_idempotent(spark):
    def rows(data):
        return spark.createDataFrame(data, "atom_id string, resolution int, text string")

    a, b = rows([("x", 10, "one two"), ("y", 10, "k")]), rows([("x", 10, "one two three"), ("z", 50, "q")])
    one, two = (sorted(map(tuple, merge.merged_summaries(*p).collect())) for p in ((a, b), (b, a)))
    assert one == two == sorted(map(tuple, merge.merged_summaries(a.unionByName(b), b).collect()))


def test_pagerank_mass_and_leak(spark):
    adj = spark.createDataFrame([("a", "b", "K", 1.0), ("b", "c", "K", 1.0)], "src string, dst string, kind string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, p double")
    rank = {r.node: r["rank"] for r in graph.pagerank(adj, seeds, rounds=20).collect()}
    want = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(20):
        want = {"a": 0.15 + 0.85 * want["c"], "b": 0.85 * want["a"], "c": 0.85 * want["b"]}
    assert all(abs(rank[k] - v) < 1e-9 for k, v in want.items()) and sum(rank.values()) <= 1 + 1e-9


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1500), (2, 1400), (3, 200), (4, 50)], "id int, tokens int")
    assert [r.id for r in retrieval.within_budget(df, order=["id"], tokens="tokens", cap=3000).collect()] == [1, 2]


def test_near_duplicates_by_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "sigma", "a", "b7"], k=rng.randint(0, 6)))) for i in range(70)]
    sets = {i: set(t.split()) for i, t in rows}
    rep = {i: min(k for k in sets if sets[k] == sets[i]) for i in sets if sets[i]}
    alike = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in rep for b in rep if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    want = {(a, b): j for (a, b), j in alike.items() if rep[a] == a and rep[b] == b} | {(r, i): 1.0 for i, r in rep.items() if i != r}
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r.a, r.b): r.jaccard for r in near.similar_pairs(df, ident="id", text="text", least=0.6).collect()} == want
    kept = []
    for i in sorted(sets):
        if not any((k, i) in alike for k in kept):
            kept.append(i)
    assert [r.id for r in near.greedy(df, ident="id", text="text").where("kept").orderBy("id").collect()] == kept
    pool = spark.createDataFrame([("alpha beta gamma",), ("",)], "text string")
    close = {i for i in sets if sets[i] and len(sets[i] & {"alpha", "beta", "gamma"}) / len(sets[i] | {"alpha", "beta", "gamma"}) >= 0.6}
    assert {r.id for r in near.near_any(df, pool, ident="id", text="text").collect()} == close


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.create_empty()
    s.create_empty()
    s.views()
    assert s.read("atoms").count() == 0 and spark.table("live_atoms").count() == 0
    old = spark.createDataFrame([("x", 1)], "id string, asserted_at int")
    assert store.migrated(old, "atoms", {"tier": F.lit("symbol")}).select("tier", "asserted_at").first() == ("symbol", 1)


def test_transcripts_batch_and_stream(spark, tmp_path):
    lines = [json.dumps({"type": "user", "sessionId": "s", "message": {"role": "user", "content": "hello there"}}), json.dumps({"type": "user", "sessionId": "s", "message": {"content": [{"type": "text", "text": "from a block"}]}}), json.dumps({"type": "user", "isSidechain": True, "message": {"content": "x"}}), json.dumps({"type": "user", "promptSource": "sdk", "message": {"content": "x"}}), json.dumps({"type": "user", "promptSource": "cli", "message": {"content": "x"}}), json.dumps({"type": "user", "promptSource": "typed", "message": {"content": "typed"}}), json.dumps({"type": "user", "promptSource": "queued", "message": {"content": [{"type": "text", "text": "two"}, {"type": "tool"}, {"type": "text", "text": "blocks"}]}}), json.dumps({"type": "user", "promptSource": "", "message": {"content": "[not json"}}), '{"type": "user", "mess']
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text("\n".join(lines))
    want = {"hello there", "from a block", "typed", "two blocks", "[not json"}
    assert {r.text for r in jsonl.transcript_messages(spark.read.text(str(tmp_path / "t"))).collect()} == want
    q = streams.transcript_stream(spark, str(tmp_path / "t")).writeStream.format("memory").queryName("messages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {r.text for r in spark.table("messages").collect()} == want


def test_heartbeat_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_type string, s long").select("event_type", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("event_type string, ts timestamp").parquet(str(tmp_path / "e"))
    q = streams.heartbeats(events).writeStream.outputMode("complete").format("memory").queryName("beats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {(r.event, r.invocations) for r in spark.table("beats").collect()} == {("a", 2), ("b", 1)}


def test_similar_sets_in_groups(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [[f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randint(1, 120))] for _ in range(60)]
    rows = [(i, " ".join(w for w in rng.choice(base) if rng.random() < 0.9)) for i in range(240)]
    sets = {i: frozenset(t.split()) for i, t in rows if t}
    rep = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    firsts = sorted(rep.values())
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in firsts for b in firsts if a < b}
    df = spark.createDataFrame(rows, "id long, text string")
    wanted = {k: round(j, 6) for k, j in jaccard.items() if j >= 0.6}
    for size, ranks in ((5_000, 1 << 16), (400, 50)):
        monkeypatch.setattr(near, "GROUP_BYTES", size)
        monkeypatch.setattr(near, "COMMON", ranks)
        classes, _ = near.token_classes(df, ident="id", text="text")
        found = near.similar_classes(classes, 0.6)
        assert "Join" not in found._jdf.queryExecution().toString()  # pairs that are not similar never are rows
        got = [((r.a, r.b), r.jaccard) for r in found.collect()]
        assert len(got) == len(dict(got)) and dict(got) == wanted
    monkeypatch.setattr(near, "PLACES", 64)  # here, not in the workers
    own = classes.collect()
    every = range(len(own))
    met = near.Sets([bytes(r.common) for r in own], [bytes(r.rare) for r in own], 0.6).similar(np.array(every), np.array(every))
    assert {(own[a].rep, own[b].rep): round(j, 6) for part in met for a, b, j in zip(*part) if own[a].rep < own[b].rep} == wanted


def test_greedy_over_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP_BYTES", 60)
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 8))) for i in range(20)] + [(20, ""), (21, "w0 w1 w2 w3 w4 w5 w6 w7")]
    sets = {i: set(t.split()) for i, t in rows}
    kept = []
    for i in sets:
        if not any(sets[k] & sets[i] and len(sets[k] & sets[i]) >= 0.6 * len(sets[k] | sets[i]) for k in kept):
            kept.append(i)
    df = spark.createDataFrame(rows, "id long, text string")
    assert [r.id for r in near.greedy(df, ident="id", text="text").where("kept").orderBy("id").collect()] == kept


def test_greedy_keeps_no_pairs_as_rows(spark, monkeypatch):
    rows = [(i, " ".join(f"c{k}" for k in range(40)) + f" own{i}") for i in range(80)] + [(80 + i, " ".join(f"w{k}" for k in range(i, i + 8))) for i in range(8)]
    sets, kept, sizes, plain = {i: set(t.split()) for i, t in rows}, [], [], near.cut
    for i in sets:
        if not any(len(sets[k] & sets[i]) >= 0.6 * len(sets[k] | sets[i]) for k in kept):
            kept.append(i)

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(near, "cut", counted)
    df = spark.createDataFrame(rows, "id long, text string")
    assert [r.id for r in near.greedy(df, ident="id", text="text").where("kept").orderBy("id").collect()] == kept
    assert max(sizes) <= len(rows)
