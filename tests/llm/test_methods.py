"""What makes each operator its method: weights and draws, corpus counts, spans, co-location, headers, short items."""

import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import common, decontamination, licenses, packing, quality, sharding, simhash, warc, words

rng = random.Random(17)
WORDS = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


# --- importance resampling -----------------------------------------------------------------------------


def small_model():
    model = quality.Model({"good": 70, "toxic": 20, "low": 10}, {"toxic": (np.array([5, 9]), np.array([-2.0, -3.0]), -0.01), "low": (np.array([7]), np.array([-4.0]), 0.0)})
    model.cuts = np.array([-1.0, -0.5])
    return model


def test_weights_by_hand():
    """log w = -log(pi + sum of pi_c exp(-margin_c)); a margin is the sum of ratios less the cut."""
    model = small_model()
    margins = model.margins_of([np.array([5, 9, 100]), np.array([7]), np.array([], dtype=np.int64)])
    assert np.allclose(margins, [[-2 - 3 + 3 * 0.01 + 1, 0.5], [0.01 + 1, -4 + 0.5], [1.0, 0.5]], atol=1e-5)
    want = -np.log(0.7 + 0.2 * np.exp(-margins[:, 0]) + 0.1 * np.exp(-margins[:, 1]))
    assert np.allclose(model.log_weight(margins), want)
    assert quality.Model({}, {}).margins(["a b"]).shape == (1, 0)


def test_draw_is_the_gumbel_top_k(spark):
    rows = [(i, prose(rng.randint(0, 30), i)) for i in range(300)] + [(None, None), (7, prose(12, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = small_model()
    every = quality.scored(docs, model).collect()
    draws = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()
    key = {(r.doc_id, r.text): model.log_weight(model.margins([r.text]))[0] / quality.TEMPERATURE - np.log(-np.log(r.u + 0.5 / (1 << 30))) for r in draws}
    assert all(abs(r["__key"] - key[r.row.doc_id, r.row.text]) < 1e-9 for r in every) and len(every) == len(rows)
    best = sorted((r["__key"] for r in every), reverse=True)
    for k in (1, 50, 301):
        got = sorted((r["__key"] for r in quality.sampled(docs, model, k=k).collect()), reverse=True)
        assert got == [x for x in best if x >= best[k - 1]]


def test_counts_cover_all_documents(spark):
    """A word that no labelled document has, but that stands beside toxic words in unlabelled ones, speaks against a text."""
    rows, labels = [], []
    for i in range(900):
        toxic, text = i % 3 == 1, prose(60, 9000 + i)
        if toxic:
            text += " nasty nasty vile" + (" zzkq" if i >= 300 else "")
        rows.append((i, text))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    plain = prose(60, 1)
    with_word, without = (model.margins([plain + x])[0].min() for x in (" zzkq", ""))
    assert with_word < without - 1


def plain_buckets(text):
    """Distinct buckets of the n-grams, word by word."""
    seed, at = 0x9E3779B97F4A7C15, set()
    codes = [words.code(w) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
    for one, stem in codes:
        at |= {one, stem + (1 << 41)}
    for (a, _), (b, _) in zip(codes, codes[1:]):
        at.add(a * 31 + b + (1 << 40))
    if len(codes) > 1:
        again = sum(a[0] == b[0] for a, b in zip(codes, codes[1:])) / (len(codes) - 1)
        at |= {(1 << 42) + i for i in range(int(10 * again))}
    return sorted({(x * seed & (1 << 64) - 1) >> 46 for x in at})


def test_word_codes_by_hand():
    crc = zlib.crc32
    assert words.code("Ab") == (crc(b"ab"), crc(b"*")) and words.code("A") == (crc(b"a"), crc(b"*"))
    assert words.code("ÉCOLES") == (crc("^écoles".encode()), crc("^école*".encode()))


def test_buckets_as_word_by_word(monkeypatch):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    cased = [c for c in every if c.isupper() or c.islower() or c.istitle() or c.lower() != c]
    texts = [every[i : i + 5000] for i in range(0, len(every), 5000)]
    texts += [" ".join(f"{c} Ab{c}cdEF {c}XYZABCD {c}{c}QQQ{c}" for c in cased), None, "", " \n", "a", "a a a b", "x" * 300 + " " + "Z" * 64 + " " + "É" * 33]
    pool = "aAbB ZΣσςİıǅßÉñ.,!_-\n\x00\x1c\x85\u2028漢字𝐀😀\u03011२"
    texts += [""] * 5000 + ["".join(random.Random(i).choices(pool + " " * (i % 9), k=i * i)) for i in range(60)]
    want = [plain_buckets(t) for t in texts]
    for piece in (words.PIECE, 100):
        monkeypatch.setattr(words, "PIECE", piece)
        found = quality.buckets_of(texts)
        assert len(found) == len(texts) and all(f.tolist() == w for f, w in zip(found, want))
    assert quality.buckets_of([]) == []


def test_no_step_of_python_for_each_word():
    """Counts of words not seen before are made without a call for each of them."""
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(100)]
    small_model().margins(texts[:1])
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        small_model().margins(texts)
    finally:
        sys.setprofile(None)
    assert len(calls) < 20_000 / 4


# --- near duplicates -------------------------------------------------------------------------------------


def test_blocks_agree_as_their_samples_do():
    text = prose(400, 3).split()
    same = simhash.block_prints(simhash.shingle_set(" ".join(text)))
    assert len(same) == simhash.BLOCKS and len(simhash.block_prints(simhash.shingle_set(""))) == 0
    changed = list(text)
    for at in range(0, 400, 100):
        changed[at] = "other"
    kept = len(set(same.tolist()) & set(simhash.block_prints(simhash.shingle_set(" ".join(changed))).tolist()))
    assert 4 <= kept < simhash.BLOCKS
    assert not set(same.tolist()) & set(simhash.block_prints(simhash.shingle_set(prose(400, 4))).tolist())


def pair_without_block(words=320, changes=7):
    """Two texts of five-word Jaccard 0.8 or more that share no block."""
    for seed in range(680, 20_000):
        r = random.Random(seed)
        text = [str(r.getrandbits(40)) for _ in range(words)]
        other = list(text)
        for at in r.sample(range(0, words, 5), changes):
            other[at] = "other"
        x, y = (simhash.shingle_set(" ".join(t)) for t in (text, other))
        shared = len(np.intersect1d(x, y))
        if shared >= 0.8 * (len(x) + len(y) - shared) and not set(simhash.block_prints(x).tolist()) & set(simhash.block_prints(y).tolist()):
            return " ".join(text), " ".join(other)
    raise AssertionError("no such pair")


def test_near_copies_without_a_common_block(spark):
    a, b = pair_without_block()
    rows = [(1, a), (2, b), (3, b), (4, prose(300, 5)), (5, b + " tail")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[3]]


@pytest.mark.parametrize("cell", [1, 64])
def test_missed_links_by_brute_force(spark, monkeypatch, cell):
    """All pairs of the similarity between components, in small cells and in full ones; usual shingles lose none."""
    monkeypatch.setattr(simhash, "USUAL", 3)
    r = random.Random(8)
    line = prose(20, 77)
    texts = [prose(30, 900 + i) + " " + line for i in range(20)]
    for base in range(5):
        text = prose(60 + 20 * base, 800 + base).split()
        for _ in range(9):
            other = list(text)
            for at in r.sample(range(len(text)), r.choice([0, 1, 1, 2, 3])):
                other[at] = r.choice(["one", "other"])
            texts.append(" ".join(other))
    rows = simhash.wide_prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), key="doc_id", text="text")
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.min("own").alias("own")).cache()
    sets = {x.node: set(np.frombuffer(x["set"], np.uint32).tolist()) for x in rows.collect()}
    part = {n: min(sets) if i % 3 == 0 else n for i, n in enumerate(sorted(sets))}
    labels = spark.createDataFrame(list(part.items()), "node long, component long")
    like = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    found = {tuple(x) for x in simhash.missed_links(nodes, rows, labels, cell=cell).collect()}
    assert found <= like and {(a, b) for a, b in like if part[a] != part[b]} <= found


@pytest.mark.parametrize("known", [0, 40])
def test_prefixes_meet(known):
    r = random.Random(known)
    usual = np.array(sorted(r.sample(range(200), known)), dtype=np.uint64), np.array([r.randint(4, 9) for _ in range(known)])
    met = 0
    for _ in range(3_000):
        x = r.sample(range(200), r.randint(1, 60))
        y = {*r.sample(x, max(1, len(x) - r.randint(0, 6))), *r.sample(range(200), r.randint(0, 6))}
        if 5 * len({*x} & y) >= 4 * len({*x} | y):
            met += 1
            a, b = (simhash.prefix(np.array(sorted(s), dtype=np.uint64), usual) for s in (x, y))
            assert set(a.tolist()) & set(b.tolist()) and len(a) == len(x) - -(-4 * len(x) // 5) + 1
    assert met > 500


@pytest.mark.parametrize("seed", range(3))
def test_asked_sets_by_brute_force(seed):
    r = random.Random(seed)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randint(0, 40))], dtype=np.uint32)) for _ in range(30)]
    table = simhash.AskedSets(sets)
    for other in sets:
        a = set(other.tolist())
        want = [i for i, s in enumerate(sets) if a & (b := set(s.tolist())) and len(a & b) / len(a | b) >= simhash.SIMILARITY]
        assert table.similar(other).tolist() == want


def test_hot_keys_join_like_others(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.counted_join(rows, table, "k", 30_000)
    assert got.count() == 30_000 and got.groupBy("k").agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("c")).where("m <> c").count() == 0


def test_a_hot_partition_is_split(spark):
    rows = spark.range(30_000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        joined = common.split_join(rows, table, "k", 30_000)
        got = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.id for r in got) == list(range(30_000)) and {r.n for r in got if r.k == -1} == {20_000}
    assert sorted(r.id for r in common.split_join(rows, table.where("k < 0"), "k", 30_000, "left_semi").collect()) == [i for i in range(30_000) if i % 3]


# --- archives ----------------------------------------------------------------------------------------------


def test_payloads_are_not_shuffled(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (1000 + i % 3)) for i in range(9)], "page_id long, url string, html string")
    found = warc.resolved(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # only names of revisits are shuffled, to be made distinct
    assert "SortMergeJoin" not in plan and all("__digest" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    rows = found.collect()
    assert {r.key: r.refers_to for r in rows if r.record_type == "revisit"} == {i: 6 + i % 3 for i in range(6)}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)


def test_string_keys_and_file_sizes(spark, tmp_path):
    big = "y" * 3000
    pages = spark.createDataFrame([(k, "u", big if k < "d" else k * 1500) for k in "abcdef"], "page_id string, url string, html string").coalesce(1)
    path = warc.write_archives(pages, str(tmp_path / "w"), size=7000)
    found = warc.read_archives(spark, path, key_type="string")
    assert {r.page_id: (r.record_type, r.refers_to) for r in found.collect()} == {"a": ("revisit", "c"), "b": ("revisit", "c"), "c": ("response", None), "d": ("response", None), "e": ("response", None), "f": ("response", None)}
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 2


def test_shuffled_when_there_are_many_revisits(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 1200) for i in range(6)] + [(None, "u", "x" * 1200), (9, None, None)], "page_id long, url string, html string")
    want = Counter((r.key, r.record_type, r.refers_to) for r in warc.resolved(pages).collect())
    monkeypatch.setattr(warc, "HELD_REVISITS", 0)
    assert Counter((r.key, r.record_type, r.refers_to) for r in warc.resolved(pages).collect()) == want


# --- licenses, shards, packing -------------------------------------------------------------------------------


def test_whole_license_texts(spark):
    mit, isc = licenses.LICENSE_TEXTS["mit-text"], licenses.LICENSE_TEXTS["isc-text"]
    words = mit.split()
    r = random.Random(3)
    jumbled = r.sample(words, len(words))
    edited = [w for i, w in enumerate(words) if i % 17] + ["indeed"]
    rows = [(1, "Copyright X.\n" + mit.upper()), (2, " ".join(edited)), (3, " ".join(jumbled)), (4, " ".join(words[: len(words) // 3])), (5, isc + "\n" + prose(3000, 8)), (6, " ".join(reversed(words)))]
    found = {x.doc_id: x for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit-text" and found[1].score == 1.0 and found[2].labels == "mit-text" and found[5].labels == "isc-text"
    assert found[3].labels == found[6].labels == "" and "bsd" not in found[1].labels


def test_spans_by_brute_force(spark):
    """The share of a template on one diagonal, with no words put in, is that of its pairs that stand there."""
    every = [licenses.Template(tuple("alpha beta gamma delta epsilon zeta".split()), "x", False, 0.8, 0)]
    r, rows = random.Random(9), []
    for i in range(60):
        rows.append((i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "other"], k=r.randint(0, 30)) + (["alpha", "beta", "gamma", "delta", "epsilon"][: r.randint(0, 5)]))))
    got = {x.doc_id: x.score for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), every=every).collect()}
    for i, text in rows:
        words, best = text.split(), 0
        for d in range(-6, len(words)):
            best = max(best, sum(1 for p in range(5) if 0 <= d + p < len(words) - 1 and tuple(words[d + p : d + p + 2]) == every[0].words[p : p + 2]))
        assert abs(got[i] - best / 5) < 1e-9, text


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i // 4 if i < 1200 else i}") for i in range(4000)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    cut = found.groupBy("text_crc32").agg(F.count_distinct("shard").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    assert cut.count() == 300 and cut.where("s > 1").count() <= 16  # the last pass may cut a unit at a quota's edge
    counts = [r["n"] for r in found.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1


def test_hot_text_is_dealt_over_shards_and_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = [(i, "same" if i < 700 else f"t{i}") for i in range(1000)] + [(None, None)] * 40
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == 1040 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))


def test_packing_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 10)
    docs = spark.createDataFrame([(i % 50, prose(i % 40, i % 7)) for i in range(300)] + [(None, None)] * 30, "doc_id long, text string")
    at = {}
    found = packing.pack_documents(docs).collect()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert len(found) == 330 and max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) + 1


# --- benchmark ---------------------------------------------------------------------------------------------------


def test_items_of_any_length_and_string_ids(spark):
    bench = spark.createDataFrame([("a", "quick red fox"), ("b", "one"), ("c", prose(40, 70)), (None, "seven small words stand here in order"), ("e", " ")], "item_id string, text string")
    rows = [(1, "the Quick, red FOX ran"), (2, "quick fox red"), (3, prose(30, 71) + " " + prose(40, 70)), (4, "seven small words stand here in order"), (5, "seven small words stand in order"), (6, "one"), (7, None)]
    coded = decontamination.coded(spark.createDataFrame(rows, "doc_id long, text string"))
    index = decontamination.build(coded, bench)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(coded, index).collect()} == {(1, "a"), (3, "c"), (4, None), (6, "b")}


def test_a_large_benchmark_is_taken_in_parts(spark, monkeypatch):
    items = [(i, prose(40, 800 + i)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    coded = decontamination.coded(spark.createDataFrame([(100 + i, prose(50, i) + " " + t) for i, t in items], "doc_id long, text string"))
    monkeypatch.setattr(decontamination, "HELD_BYTES", 100_000)
    indexes = decontamination.indexes(coded, bench)
    assert len(indexes) > 1 and sum(len(x.ids) for x in indexes) == 12
    assert {(r.doc_id, r.item_id) for x in indexes for r in decontamination.leaks(coded, x).collect()} == {(100 + i, i) for i in range(12)}


def test_candidates_by_brute_force(spark):
    """The search finds every window of a passage's words of which the exact check would accept the pair."""
    items = [(i, prose(40, 400 + i)) for i in range(20)]
    r, rows = random.Random(5), []
    for i in range(60):
        words = items[i % 20][1].split()
        for at in r.sample(range(40), r.choice([0, 3, 6])):
            words[at] = r.choice(WORDS)
        rows.append((i, prose(r.randint(0, 60), 500 + i) + " " + " ".join(words) + " " + prose(30, 600 + i)))
    coded = decontamination.coded(spark.createDataFrame(rows + [(100 + i, prose(120, 700 + i)) for i in range(60)], "doc_id long, text string"))
    index = decontamination.build(coded, spark.createDataFrame(items, "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in decontamination.leaks(coded, index).collect()}
    assert found == {(i, i % 20) for i in range(60)}


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_on_nulls_repeats_and_empty(spark, tmp_path):
    rows = [(i if i % 5 else None, prose(60, 7000 + i // 2), "en", "s", 1, 1) for i in range(60)] + [(7, None, None, None, None, 1), (7, "", "en", "s", 0, 1), (5000, "x" * 400_000, "en", "s", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id int"
    for name, kept in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(kept, schema).write.parquet(folder + "/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
        spark.createDataFrame([(1, prose(60, 7003)), (None, None)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        texts = Counter(t for _, t, *_ in kept if t and t.startswith(tuple(WORDS)))
        # one document of each pair of copies stays, but that of the benchmark's text
        assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
        assert sum(r.piece == 0 and r.doc_id != 5000 for r in out) == (len(texts) - 1 if kept else 0)


def test_shared_folder_is_wanted_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Known:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Known()})()})()

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_chunks_meet_as_pairs_do(spark):
    """All links between components of a cell; a row carries two chunks, not a chunk for each node."""
    r = random.Random(4)
    base = [sorted(r.sample(range(10_000), 40)) for _ in range(3)]
    found = [(i, i % 2, np.array(sorted({*base[i % 3][: 40 - r.randint(0, 4)], 20_000 + i}), dtype=np.uint32)) for i in range(200)]
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, _, s in found], "node long, set binary")
    rows = spark.createDataFrame([(7, i, part, len(s)) for i, part, s in found], "cell long, node long, component long, size int")
    chunks = simhash.in_chunks(rows, sets, 200)
    sizes = [len(c.nodes) for c in chunks.collect()]
    assert sum(sizes) == 200 and max(sizes) < 2 * simhash.CHUNK and len(sizes) >= 3
    asks = simhash.in_chunks(rows.where("node < 100"), sets, 200)
    same = lambda x, y: len(np.intersect1d(x, y)) >= simhash.SIMILARITY * len(np.union1d(x, y))
    want = {(min(i, j), max(i, j)) for i, p, x in found for j, q, y in found[:100] if p != q and same(x, y)}
    assert want and {tuple(x) for x in simhash.met_in_chunks(chunks, asks).collect()} == want


def test_filed_blocks_pass_one_join(spark, monkeypatch):
    """All blocks of all nodes meet the counts of their cells once, also where a cell is hot; no pair of it is lost."""
    hot = 240
    of = lambda i: np.arange(40 * (i // 2) if i < hot else 10**6 + 40 * i, (40 * (i // 2) if i < hot else 10**6 + 40 * i) + 40 + (i % 2), dtype=np.uint32)  # noqa: E731  two and two alike
    node = F.col("id")
    nodes = spark.range(20_002).select(node.alias("node"), F.lit(40).alias("size"), F.lit(0).cast("long").alias("print"), F.when(node < hot, F.array(F.lit(-1).cast("long"), node + 1)).otherwise(F.array(node + 1)).alias("blocks"), node.alias("own"))
    rows = spark.createDataFrame([(i, i, bytearray(of(i).tobytes())) for i in range(hot + 1)], "own long, node long, set binary")
    plans, write = {}, simhash.staged

    def spy(df, tag, *more):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, *more)

    monkeypatch.setattr(simhash, "staged", spy)
    links = {(r.a, r.b) for r in simhash.similar_links(nodes, rows).collect()}
    assert links == {(i, i + 1) for i in range(0, hot, 2)}
    assert plans["cells"] and not any("LeftAnti" in p or p.count("Generate") > 1 for p in plans["cells"] + plans["open"])


def test_staged_tables_pass_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = spark.range(5_000, numPartitions=1).mapInArrow(sizes, "n long")
    assert [r.n for r in common.staged(rows, "sizes").collect()] == [1024] * 4 + [904]
    assert max(r.n for r in common.staged(rows, "sizes", 64).collect()) == 64 and spark.conf.get(name) == before
