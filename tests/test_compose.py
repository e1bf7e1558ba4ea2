"""Composites on a small store."""

from pyspark.sql import functions as F

from factloom import model
from factloom.operators import compose


def frame(spark, schema, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in rows], schema)


def small(spark):
    base = {"archived": False, "pinned": False, "confidence": 1.0, "type": "glossary", "workspace_id": "w", "asserted_at": 100, "valid_from": 100, "source_kind": "file"}
    atoms = frame(spark, model.ATOMS, [base | {"id": i, "topic_key": t, "source_ref": p, "repo_id": r} for i, t, p, r in [("a", "symbol:x/a.py:alpha", "x/a.py:1", "r1"), ("b", "symbol:y/b.py:alpha", "y/b.py:0", "r2"), ("c", "rule", "x/c.md", "r1"), ("d", "old", "x/d.md", "r1")]])
    atoms = atoms.withColumn("valid_to", F.when(F.col("id") == "d", 150))
    edges = frame(spark, model.EDGES, [{"id": "e1", "src_id": "a", "dst_id": "c", "kind": "REFERENCES", "directed": True, "weight": 0.6, "confidence": 1.0, "status": "live"}, {"id": "e2", "src_id": "a", "dst_id": "d", "kind": "CONTRADICTS", "directed": False, "weight": 1.0, "confidence": 1.0, "status": "live"}])
    vectors = frame(spark, model.VECTORS, [{"atom_id": "a", "model": "m", "vector": [1.0, 0.0]}, {"atom_id": "c", "model": "other", "vector": [1.0, 0.0]}])
    return atoms, edges, vectors


def test_retrieve(spark):
    atoms, edges, vectors = small(spark)
    hits = {r.id: r for r in compose.retrieve(atoms, edges, vectors, [1.0, 0.0], model="m", now=100).collect()}
    assert set(hits) == {"a", "c"} and hits["a"].relevance == 1.0 and hits["c"].relevance == -1.0 and hits["c"].trail == "1-hop via REFERENCES" and hits["a"].state == "none"
    recent = compose.retrieve(atoms, edges, vectors, [1.0, 0.0], model="none", now=100).collect()
    assert {r.id for r in recent} == {"a", "b", "c"} and all(r.score == 0 and r.relevance == -1 for r in recent)
    by_file = compose.retrieve(atoms, edges, vectors, [1.0, 0.0], model="none", files=("y/b.py",), now=100).collect()
    assert [r.id for r in by_file] == ["b"]


def test_discover_and_why(spark):
    atoms, edges, _ = small(spark)
    summaries = frame(spark, model.SUMMARIES, [{"atom_id": "c", "resolution": 50, "text": "see x/a.py and x/c.md", "token_count": 5}])
    changes = spark.createDataFrame([(c, p) for c in range(4) for p in ("x/a.py", "x/c.md")] + [(9, f"f{i}") for i in range(26)], "commit_id int, path string")
    got = {(r.src_id, r.dst_id, r.kind, round(r.weight, 4)) for r in compose.discovered(atoms, summaries, changes).collect()}
    assert got == {("c", "a", "REFERENCES", 0.6), ("a", "b", "MIRRORS", 0.8), ("a", "c", "CO_CHANGED", 0.4)}
    evidence = spark.createDataFrame([("e1", "k", "p")], "edge_id string, kind string, payload string")
    assert [(r.other, r.direction, r.payloads) for r in compose.why(atoms, edges, evidence, "a").collect()] == [("d", "out", None), ("c", "out", ["p"])]
    assert [r.dst_id for r in compose.blocks(atoms, "z", ["x/c"]).collect()] == ["c"]
    assert {r.id for r in compose.closed_edges(edges, edges.where("id = 'e1'"), 5).where("valid_to = 5").collect()} == {"e1"}
    assert {r.id for r in compose.list_edges(edges, "d").collect()} == {"e2"}


def test_retrieve_verifies_substitutes_and_drills(spark):
    """A hit that fails gives its place to the next; children of a hot module come; past the horizon a fact is unconfirmed."""
    base = {"archived": False, "pinned": False, "confidence": 1.0, "type": "glossary", "workspace_id": "w", "asserted_at": 100, "valid_from": 100, "source_kind": "readme"}
    about = [("a", {}), ("m", {"tier": "module"}), ("x", {"liveness_kind": "regex", "liveness_target": "f", "liveness_pattern": "gone"}), ("y", {"liveness_kind": "regex", "liveness_target": "f", "liveness_pattern": "here"}), ("z", {"confirm_by": 50}), ("n", {"liveness_kind": "regex", "liveness_target": "g", "liveness_pattern": "q", "liveness_last_ok": 90})]
    atoms = frame(spark, model.ATOMS, [base | {"id": i, "topic_key": "t:" + i, "tier": "symbol"} | more for i, more in about])
    roll = lambda i: {"id": "e" + i, "src_id": i, "dst_id": "m", "kind": "ROLLS_UP", "directed": True, "weight": 1.0, "confidence": 1.0, "status": "live"}
    edges = frame(spark, model.EDGES, [roll(i) for i in "axyzn"])
    vectors = frame(spark, model.VECTORS, [{"atom_id": "a", "model": "m", "vector": [1.0, 0.0]}])
    sources = spark.createDataFrame([("f", "it is here"), ("g", "nothing")], "path string, text string")
    found = {r.id: r for r in compose.retrieve(atoms, edges, vectors, [1.0, 0.0], model="m", now=100, sources=sources).collect()}
    assert {i: r.state for i, r in found.items()} == {"a": "none", "m": "none", "y": "verified", "z": "unconfirmed", "n": "trusted"}
    flat = {r.id for r in compose.retrieve(atoms, edges, vectors, [1.0, 0.0], model="m", now=100, drill=False).collect()}
    assert flat == {"a", "m"}


def test_scaffolding(spark):
    """Literal topics and whether they serve retrieval only."""
    want = {"module:src": True, "symbol:tests/a.py:f": True, "symbol:src/__tests__/a.ts:f": True, "symbol:spec/a.rb:f": True, "symbol:src/a_test.py:f": True, "symbol:src/a.test.ts:f": True, "symbol:src/TestA.java:f": True, "symbol:src/latest.py:f": False, "symbol:src/a.py:test_f": False, "symbol:f": False, "rule": False}
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.s for r in rows.select("t", compose.scaffolding(F.col("t")).alias("s")).collect()} == want


def test_route(spark):
    hits = spark.createDataFrame([("a", "rule", 0.9, 0.5), ("b", "module:x", 0.8, 0.9), ("c", "rule2", 0.7, 0.1), ("d", "rule3", 0.6, -1.0)], "id string, topic_key string, score double, relevance double")
    atoms = frame(spark, model.ATOMS, [{"id": i, "type": "decision" if i == "a" else "invariant", "decision_status": "CLOSED" if i == "a" else None, "source_ref": "f.py", "source_kind": "commit" if i == "a" else "readme"} for i in "abcd"])
    summaries = frame(spark, model.SUMMARIES, [{"atom_id": i, "resolution": 50, "text": i * 8000, "token_count": 2000} for i in "abcd"])
    assert [r.id for r in compose.routed(hits, atoms, summaries, "semantic", floor=0.25).collect()] == ["a"]
    short = frame(spark, model.SUMMARIES, [{"atom_id": i, "resolution": 50, "text": i, "token_count": 1} for i in "abcd"])
    got = compose.routed(hits, atoms, short, "semantic").orderBy(F.desc("score")).collect()
    assert [r.line for r in got] == ["- [DECIDED/CLOSED] a", "- [INVARIANT] c _(f.py)_", "- [INVARIANT] d _(f.py)_"]
    assert model.ROUTES == {"navigational": (3, 10), "semantic": (5, 50), "contradictory": (7, 50), "implementation": (5, 50)}
