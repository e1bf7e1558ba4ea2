"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, decontamination, jpeg, language_id, licenses, packing, quality, sharding, simhash, token_counts, warc

random.seed(7)
WORDS = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices(WORDS, k=n))


TEXTS = [None, "", "  \n\t ", "one", "MIT License, the mit  license; Apache License! GNU General Public License", "né à l'été ½ ² 日本語 🙂 \x1c x <|endoftext|> y", prose(300, 1), prose(300, 1), prose(300, 1) + " tail", prose(5000, 2), "a   b \n\n  c", "x" * 5000, "Zebra?  It's 3.14 — “ok”…"]
TEXTS += [prose(random.randint(1, 400), 100 + i) for i in range(40)]
ROWS = [(i if i != 11 else None, t, random.choice(["en", "de", None]), 5) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], ROWS[6], (6, "another text of six", "en", 1)]
SCHEMA = "doc_id long, text string, lang string, sequence_id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return bpe.library(bpe.default_dir())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, none, library):
    want = Counter((r[0], len((r[1] or "").encode()), n := len(ids_of(library, r[1])), n > 1024) for r in ROWS)
    assert Counter(map(tuple, token_counts.token_counts(docs).collect())) == want
    assert token_counts.token_counts(none).count() == 0


def test_ids_equal_the_library(library):
    encode = bpe.IdEncoder(bpe.default_dir(), limit=50)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("ab c  \n\t'sé.,1² –\x1c <|", k=rng.randint(0, 40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(library, text), repr(text)


def test_packing(docs, none, library):
    found = packing.pack_documents(docs).collect()
    lengths = sorted(len(ids_of(library, r[1])) + 1 for r in ROWS)
    by_piece = Counter()
    for r in found:
        by_piece[r.doc_id, r.piece] += 1
        assert 0 < r.length <= 2048
    assert sum(r.length for r in found) == sum(lengths)
    whole = {r[0]: ids_of(library, r[1]) + [0] for r in ROWS if r[0] != 6}
    for r in found:
        if r.doc_id in whole and r.doc_id is not None:
            own = whole[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    at = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.3, 0.9, 20000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    groups = packing.plan(histogram)
    held = Counter()
    for pattern, n in groups:
        assert sum(pattern) <= 2048
        for x in pattern:
            held[x] += n
    assert held == Counter({i: int(c) for i, c in enumerate(histogram) if c})
    assert sum(n for _, n in groups) <= 1.01 * math.ceil(lengths.sum() / 2048) + 1


def test_language_codes_are_exact():
    train = {"aa": [b"abab abab", b"aba"], "bb": [b"cdcd cdc"]}
    rows = [r for lang, texts in train.items() for r in language_id.counted(lang, texts, 3)]
    counts = {}
    for n in range(1, 5):
        own = sorted((lang == "bb", g, k) for lang, m, g, k in rows if m == n)
        counts[n] = tuple(np.array(c, d) for c, d in zip(zip(*own), (np.int64, np.uint32, np.int64)))
    trees = language_id.Trees(["aa", "bb"], counts, 3)

    def brute(text, lang):
        follow = {}
        for t in train[lang]:
            t = b"\n\n\n" + t
            for i in range(3, len(t)):
                for k in range(4):
                    follow.setdefault(t[i - k : i], Counter())[t[i]] += 1
        total, data = 0.0, b"\n\n\n" + text
        for i in range(3, len(data)):
            for k in range(3, -1, -1):
                c = follow.get(data[i - k : i])
                if not c:
                    continue
                n = sum(c.values()) + len(c)
                if data[i] in c:
                    total -= math.log2(c[data[i]] / n)
                    break
                total -= math.log2(len(c) / n)
            else:
                total += 8
        return total

    for text in (b"abab", b"dcdc ab", b"\xc3\xa9zz", b"a"):
        got = trees.score([text])[0]
        assert np.allclose(got, [brute(text, "aa"), brute(text, "bb")], atol=1e-3)


def test_language_contract(spark, none):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", 0) for i in range(100)]
    rows += [(200, None, "en", 0), (201, "12 ?", None, 0), (None, "the cat", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = language_id.identify(df, language_id.train(df)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        want = "und" if r.doc_id in (200, 201) else "en" if r.doc_id is None or r.doc_id % 2 else "de"
        assert r.lang_pred == want and 0 <= r.score <= 1
    assert language_id.identify(none, language_id.train(none)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "http://a/ b", big), (2, "http://a", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (3, "u", big), (8, "u", "x" * 999), (9, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    found = warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "w"))).collect()
    want = Counter()
    for key, _, html in rows:
        data = (html or "").encode()
        again = html == big and key != 3
        want[key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert Counter(map(tuple, found)) == want
    empty = warc.write_archives(df.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark, empty).count() == 0


def test_jpeg_store_round_trip(docs, none):
    found = jpeg.media_features(jpeg.media_column(docs)).collect()
    want = Counter()
    for key, text, *_ in ROWS:
        data = (text or "").encode()
        full = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want[key, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert jpeg.media_features(jpeg.media_column(none)).count() == 0


def entropy_coded(blocks, dc, ac, interval):
    """Reference encoder: one component, any tables, bit by bit."""
    def codes(table):
        out, code, at = {}, 0, 0
        for length, n in enumerate(table[0], 1):
            for s in table[1][at : at + n]:
                out[s] = format(code, f"0{length}b")
                code += 1
            at, code = at + n, code << 1
        return out

    def bits(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    d, a, out, text, last = codes(dc), codes(ac), b"", "", 0

    def flush(text):
        text += "1" * (-len(text) % 8)
        return b"".join(bytes([int(text[i : i + 8], 2)]) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for n, block in enumerate(blocks):
        if interval and n and n % interval == 0:
            out += flush(text) + bytes([0xFF, 0xD0 + (n // interval - 1) % 8])
            text, last = "", 0
        size, raw = bits(block[0] - last)
        text, last, run = text + d[size] + raw, block[0], 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                text, run = text + a[0xF0], run - 16
            size, raw = bits(v)
            text, run = text + a[run << 4 | size] + raw, 0
        if run:
            text += a[0]
    return out + flush(text)


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_jpeg_decodes_general_tables(interval):
    rng = random.Random(interval)
    dc = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7), bytes(range(12)))
    symbols = bytes(r << 4 | s for r in range(16) for s in range(1, 11)) + bytes([0, 0xF0])
    ac = (bytes([0] * 7 + [162] + [0] * 8), symbols)
    images, blocks = [], []
    for w, h in ((3, 2), (5, 1)):
        own = [[rng.randint(-200, 200)] + [rng.choice([0] * 9 + [rng.randint(-500, 500)]) for _ in range(63)] for _ in range(w * h)]
        body = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes([3]) + b"\1" * 63), jpeg._segment(0xC0, bytes([8, 0, 8 * h - 3, 0, 8 * w - 1, 1, 1, 0x11, 0])), jpeg._segment(0xC4, b"\0" + dc[0] + dc[1]), jpeg._segment(0xC4, b"\x10" + ac[0] + ac[1])]
        body += [jpeg._segment(0xDD, bytes([0, interval]))] if interval else []
        images.append(b"".join(body) + jpeg._segment(0xDA, b"\1\1\0\0\x3f\0") + entropy_coded(own, dc, ac, interval) + b"\xff\xd9")
        blocks.append(own)
    for (image, got), own in zip(jpeg.decoded(images), blocks):
        assert got.tolist() == own
        thumb = jpeg.thumbnail(image, got)
        want = [min(255, max(0, ((b[0] * 3) >> 3) + 128)) for b in own]
        assert thumb.ravel().tolist() == want
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


def test_license_scan(docs, none):
    lower = str.maketrans(licenses.UPPER, licenses.LOWER)
    want = Counter()
    for key, text, *_ in ROWS:
        words = re.findall(licenses.WORD, (text or "").translate(lower))
        at, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[key, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    found = licenses.scanned(docs).collect()
    assert Counter(tuple(r)[:6] for r in found) == want
    assert licenses.scanned(none).count() == 0


def test_license_texts_with_gaps(spark):
    text = "Permission is hereby granted, free of charge, to any lucky person obtaining a copy"
    df = spark.createDataFrame([(1, text), (2, "permission granted to a person")], "doc_id long, text string")
    assert [r.labels for r in licenses.scanned(df).orderBy("doc_id").collect()] == ["mit-text", ""]


def test_sharding(docs, none):
    found = sharding.sharded(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    assert sharding.sharded(none).count() == 0


def brute_components(prints, keys, radius=2):
    low = {}
    for _ in range(len(prints)):
        before = dict(low)
        for i, p in enumerate(prints):
            near = [j for j, q in enumerate(prints) if (p ^ q).bit_count() <= radius]
            low[i] = min((low.get(j, keys[j]) for j in near if low.get(j, keys[j]) is not None), default=None)
        if low == before:
            break
    return low


def test_near_duplicates(docs, none):
    found = simhash.near_duplicates(docs).collect()
    prints, keys = simhash.fingerprints([r[1] for r in ROWS]), [r[0] for r in ROWS]
    low = brute_components(prints, keys)
    want = Counter((k, f"{p:016x}", low[i]) for i, (k, p) in enumerate(zip(keys, prints)))
    assert Counter(map(tuple, found)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    words = "a B a b c".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprints(["a B a\n b c", None, ""]) == [want, 0, 0]


@pytest.mark.parametrize("cell", [1, 64])
def test_links_in_crowded_cells(spark, cell):
    rng = random.Random(5)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(60):
        p = centre
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
            p ^= 1 << b
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "print long, low long")
    got = {r["print"]: r.component for r in simhash.components(nodes, simhash.links_between(nodes.select("print"), cell=cell)).collect()}
    low = brute_components(prints, list(range(len(prints))))
    assert got == {simhash.signed(p): low[i] for i, p in enumerate(prints)}


def test_deduplicated_keeps_texts_without_copies(docs):
    """A row goes only if a near duplicate of its own text stays, whatever the keys."""
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    low = jaccard_components([r[1] for r in ROWS])
    assert Counter(low[[x[1] for x in ROWS].index(r.text)] for r in found) == Counter(set(low))
    assert [r.doc_id for r in found if r.text == "another text of six"] == [6] and 7 not in [r.doc_id for r in found]


def test_rows_without_key_stay(spark):
    """Groups of rows without key keep one row each; other texts of such rows stay; the key "null" is a key."""
    a, b, c = prose(90, 60), prose(90, 61), prose(90, 62)
    rows = [(None, a), (None, a), (None, b), (None, c), (4, c), (5, prose(90, 63))]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, a), (None, b), (4, c), (5, rows[5][1])], key=repr)
    named = [("null", a), (None, b), ("6", b + " tail"), ("6", c), ("7", prose(90, 64))]
    kept = simhash.deduplicated(spark.createDataFrame(named, "doc_id string, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([named[0], named[2], named[3], named[4]], key=repr)
    assert simhash.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if v == b else v for v in low]
    return low


@pytest.mark.parametrize("asking", [3, 1])
def test_near_copies(spark, asking):
    """All that five-word Jaccard 0.8 joins, in full cells too; rows that share a key stand for their texts."""
    rng, rows = random.Random(11), []
    for base in range(6):
        words = prose(60 + 20 * base, 700 + base).split()
        for copy in range(14):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.choice([0, 1, 1, 2, 3, 4])):
                changed[at] = "other"
            rows.append((base * 20 + copy, " ".join(changed)))
    line = prose(30, 720)
    rows += [(200 + i, line + " " + prose(rng.randint(0, 12), 730 + i)) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a  B"), (304, "b a"), (None, prose(40, 750)), (None, prose(40, 751)), (305, prose(40, 751))]
    rows += [(3, prose(50, 752)), (306, prose(50, 752) + " x"), rows[5], rows[5]]
    low = jaccard_components([t for _, t in rows])
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), asking=asking).collect()
    best = {c: min((k is None, k or 0) for (k, _), v in zip(rows, low) if v == c) for c in low}
    of = {(k, t): c for (k, t), c in zip(rows, low)}
    assert len(kept) == len(best) and sorted(of[tuple(r)] for r in kept) == sorted(best)
    assert all((r.doc_id is None, r.doc_id or 0) == best[of[tuple(r)]] for r in kept)


def bench_table(spark):
    return spark.createDataFrame([(1, prose(40, 900)), (2, prose(18, 901)), (3, None), (None, prose(60, 902)), (4, "too short")], "item_id long, text string")


def test_leaks(spark, none):
    bench = bench_table(spark)
    one, two, free = prose(40, 900), prose(18, 901), prose(60, 902)
    changed = " ".join(w if i % 6 else "other" for i, w in enumerate(one.split()))
    rows = [(i, prose(200, 2000 + i), "en", 1) for i in range(60)]
    rows += [(100, prose(50, 1) + " " + one + " " + prose(70, 2), "en", 1), (101, two.upper(), "en", 1), (102, prose(33, 5) + " " + changed, "en", 1), (103, None, "en", 1), (104, "", None, 1), (105, free, "en", 1), (100, one, "en", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    coded = decontamination.coded(df)
    index = decontamination.build(coded, bench)
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(coded, index).collect()}
    assert found == {(100, 1), (101, 2), (102, 1), (105, None)}
    kept = decontamination.accepted(df, index)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(60), 103, 104}
    empty = decontamination.coded(none)
    assert decontamination.leaks(empty, decontamination.build(empty, bench)).count() == 0
    assert decontamination.leaks(coded, decontamination.build(coded, bench.where("false"))).count() == 0


@pytest.mark.parametrize("words, first, length", [(50, 5, 26), (40, 5, 25), (64, 18, 22), (70, 31, 20)])
def test_quotes_between_passages_leak(spark, words, first, length):
    """Verbatim quotes leak wherever in the item they start."""
    item = prose(words, 950 + words)
    quote = " ".join(item.split()[first : first + length])
    rows = [(i, prose(200, 2000 + i)) for i in range(60)] + [(100 + at, prose(40 + at, 960 + at) + " " + quote + " " + prose(50, 980 + at)) for at in range(12)]
    coded = decontamination.coded(spark.createDataFrame(rows, "doc_id long, text string"))
    index = decontamination.build(coded, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in decontamination.leaks(coded, index).collect()} == {100 + at for at in range(12)}


def test_common_length():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.choices(range(6), k=rng.randint(1, 20)), rng.choices(range(6), k=rng.randint(0, 30))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        mask = {}
        for i, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << i
        assert decontamination.common_length(mask, len(a), b) == table[-1][-1]


def quality_tables(spark):
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = prose(80, 5000 + i)
        text = text if kind == 0 else text.replace(" ", " nasty ", 3) if kind == 1 else " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", 0))
        if i < 500:
            labels.append((i, int(kind != 2), int(kind == 1)))
    rows += [(1000, None, None, 0), (1001, "", None, 0)]
    labels += [(None, 1, 0), (3, None, 0), (2000, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    docs, labels = quality_tables(spark)
    found = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    for i in range(500, 600):
        assert (i in found) == (i % 3 == 0), i
    assert quality.accepted(none, labels).count() == 0
    assert quality.accepted(docs, labels.where("false")).count() == docs.count()


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), 1.5, -2.0]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quality.kth_largest(df, k)
    assert got == (sorted(values)[-k] if k else float("inf"))


def test_pipeline_stages(spark, tmp_path):
    docs, labels = quality_tables(spark)
    docs = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(3000).cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(80, 5003))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i in found if i < 500} <= {i for i in range(0, 500, 3)} and 3 not in found and 3000 not in found and 0 in found
    assert not found & {1000, 1001}


def test_clashing_columns(spark):
    """Columns with the operators' own names, and with dots, pass the filtering stages as they came."""
    docs, labels = quality_tables(spark)
    for name in ("k", "t", "row", "codes", "print", "label", "a.b", "__key", "words", "score"):
        docs = docs.withColumn(name, F.lit(1))
    for kept in (quality.accepted(docs, labels), simhash.deduplicated(docs), language_id.accepted(docs, language_id.train(docs))):
        assert kept.columns == docs.columns and kept.count() > 0
    index = decontamination.build(decontamination.coded(docs), bench_table(spark))
    assert decontamination.accepted(docs, index).columns == docs.columns
    assert token_counts.token_counts(docs).count() == sharding.sharded(docs).count() == licenses.scanned(docs).count() == docs.count()
    assert packing.pack_documents(docs).count() >= docs.count()
