"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints are grouped into distinct values first, so exact and equal-print copies cost nothing
further. The 64 bits are then grouped into partitions, correlated bits together, and each partition
gets a threshold of its own (-1: not probed) with sum(threshold + 1) = radius + 1: two prints within
``radius`` bits differ by at most the threshold in at least one partition. Partitions and thresholds
come from a dynamic programme over candidate counts that are estimated from all prints.

A partition is probed by signatures: every print files its own partition value, and asks for each
value within the threshold. Cells are compared pair by pair while small. A cell too full for that
takes an exact, linear way (radius 2 or less): every member files itself and its 64 one-bit
neighbours, and all that file the same value - they are pairwise within two bits - link to the
smallest. Components are found by star contraction between distinct prints.

``deduplicated`` groups by a similarity instead (five-word Jaccard of 0.8 or more). One print of a whole
text cannot carry that: such pairs differ in up to some 18 of 64 bits, and a pigeonhole of that radius
makes candidates of several hundredths of all pairs. A text's print is therefore widened to ``BLOCKS``
prints of 64 bits, each the SimHash of a small sample of its shingles: the smallest ``SAMPLE`` hashes of
a sixteenth of the hash space. All bits of such a block are correlated: they agree together where the
samples do, and like chance otherwise. So the pigeonhole's partitions are the blocks, threshold 0 in each:
two texts of similarity s agree in a block with probability of about s ** SAMPLE or more, which at 0.8 misses
one pair in six hundred. Candidates are verified by their whole shingle sets.

What the blocks miss is found exactly (``missed_links``): sets of similarity 0.8 share a shingle among the first fifth
of each, in any order that is the same for all, and every text files that fifth. Only shingles at which texts of
different components meet make candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, counted_join, map_batches, quoted, read, slices, split_join, staged

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Words of a shingle, and least Jaccard similarity, where rows are grouped by similarity.
WIDE, SIMILARITY = 5, 0.8
#: Blocks of a wide print, and shingles that a block samples.
BLOCK_BITS, SAMPLE = 4, 5
BLOCKS = 1 << BLOCK_BITS
#: Nodes, about, that each cell compares with all its others at first; of the others, how many a chunk takes, and
#: of how many shingles, which bounds what a row carries; and rows of two chunks in a batch.
ASKING, CHUNK, CHUNK_SIZE, ROWS_OF_CHUNKS = 3, 48, 8_000, 64
#: Bits in which whole prints of a pair may differ: at similarity 0.8 ten are usual, with a deviation below three.
FAR = 21
#: Texts, about, of a hash sample that tells which shingles are usual, how many of them hold such a shingle, and how many
#: shingles are told at most. It sets the order in which a text files its shingles, hence the speed, never the result.
ORDER_TEXTS, USUAL, USUAL_MOST = 10_000, 4, 1 << 20
#: Members of a cell that are compared pair by pair; fuller cells take the linear way.
CELL = 64
#: Members of a shingle's cell whose pairs are counted as rows before any is verified; fuller cells are compared in chunks.
SHARED_CELL = 512
_MASK = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode().lower().split()


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``k`` words, repeats included; of the whole sequence where it is shorter."""
    words = words_of(text)
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprints(texts: list[str | None], k: int = SHINGLE) -> list[int]:
    """A bit is 1 if it is set in over half the hashes; no words: 0."""
    return [majority(shingle_hashes(t, k)) if t else 0 for t in texts]


def majority(hashes: list[int]) -> int:
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    data = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(data), 1 << 16):  # a very long text needs no large table of bits
        votes += np.unpackbits(data[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(data)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key and ``print``, the fingerprint as a signed long, of every row; null text has no words."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batch: pa.RecordBatch) -> dict:
        keys, texts = columns_of(batch, "k", "t")
        return {"k": keys, "print": pa.array([signed(p) for p in fingerprints(texts, shingle)], pa.int64())}

    return map_batches(rows, run, f"k {rows.schema['k'].dataType.simpleString()}, print long").toDF(key, "print")


# --- partitions and thresholds -------------------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of prints, ones per bit, and pairs of ones per two bits, over all prints."""

    def count(batches):
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            data = batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(data, axis=1).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"n": [n], "both": pa.array([both.ravel().tolist()], pa.list_(pa.float64()))})

    parts = prints.select("print").mapInArrow(count, "n long, both array<double>")
    both, total = np.zeros(4096), 0
    for row in parts.select(F.posexplode(F.concat("both", F.array(F.col("n").cast("double")))).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        if row["at"] < 4096:
            both[row["at"]] = row["v"]
        else:
            total = int(row["v"])
    both = both.reshape(64, 64)
    return total, np.diag(both).copy(), both


def ordered_bits(n: int, ones: np.ndarray, both: np.ndarray) -> list[int]:
    """Bits (0: highest) in an order that keeps correlated bits side by side: greedy nearest neighbour."""
    mean = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    like = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(like, -1)
    order = [int(np.unravel_index(like.argmax(), like.shape)[0])]
    left = set(range(64)) - set(order)
    while left:
        nxt = max(sorted(left), key=lambda b: like[order[-1], b])
        order.append(nxt)
        left.remove(nxt)
    return order


def allocation(n: int, ones: np.ndarray, order: list[int], radius: int, most: int = 4) -> list[tuple[list[int], int]]:
    """Partitions (their bits) with a threshold each, at the least estimated cost.

    The probability that two prints agree in a bit is estimated from its share of ones, so a run of
    bits that starts at ``i`` and ends before ``j`` matches within t bits with a probability that a
    recurrence gives; the programme picks the cuts and the thresholds. Cost: signatures filed plus
    candidate pairs, both counted for ``n`` prints.
    """
    p = (ones / max(n, 1))[order]
    differ = 2 * p * (1 - p)
    at_most = np.zeros((65, 65, radius + 1))  # [i, j, t]
    for i in range(64):
        exact = np.zeros(radius + 1)
        exact[0] = 1
        for j in range(i + 1, 65):
            d = differ[j - 1]
            exact = exact * (1 - d) + np.concatenate([[0], exact[:-1]]) * d
            at_most[i, j] = np.cumsum(exact)
    pairs = n * (n - 1) / 2

    def cost(i: int, j: int, t: int) -> float:
        if t < 0:
            return 0.0
        width = j - i
        asked = sum(_choose(width, x) for x in range(t + 1))
        return n * (1 + (asked if t else 0)) + pairs * at_most[i, j, t]

    best: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    for m in range(most):
        for j in range(1, 65):
            for spent in range(radius + 2):
                options = [
                    (best[(m, i, spent - t - 1)][0] + cost(i, j, t), (*best[(m, i, spent - t - 1)][1], (i, j, t)))
                    for t in range(-1, min(radius, spent - 1) + 1)
                    for i in range(j)
                    if (m, i, spent - t - 1) in best
                ]
                if options:
                    best[(m + 1, j, spent)] = min(options)
    _, cuts = min(best[(m, 64, radius + 1)] for m in range(1, most + 1) if (m, 64, radius + 1) in best)
    return [([order[x] for x in range(i, j)], t) for i, j, t in cuts if t >= 0]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _mask(bits) -> int:
    return signed(sum(1 << (63 - b) for b in bits))


# --- probing ---------------------------------------------------------------------------------------


def links_between(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b), a < b, between distinct prints: their components are those of all pairs within ``radius``.

    All pairs of small cells are there; in a full cell, only the links that join what is to be joined.
    """
    if radius > 2:
        raise ValueError("full cells are exact up to two bits")
    n, ones, both = bit_statistics(prints)
    found = crowded = None
    for bits, t in allocation(n, ones, ordered_bits(n, ones, both), radius):
        mask = F.lit(_mask(bits))
        flips = [_mask(c) for x in range(1, t + 1) for c in combinations(bits, x)]
        own = prints.select("print", F.col("print").bitwiseAND(mask).alias("cell"))
        # cells are counted first: only the members of small ones are ever gathered
        sizes = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.lit(True) if flips else F.col("n") > 1)
        filed = counted_join(own, sizes, "cell", n)
        members = filed.where(F.col("n") <= cell).groupBy("cell").agg(F.collect_list("print").alias("members"))
        if flips:
            asks = own.select("print", F.explode(F.array(*[F.col("cell").bitwiseXOR(F.lit(x)) for x in [0, *flips]])).alias("cell"))
            asks = counted_join(asks, sizes, "cell", n)
        else:
            asks = filed
        # probe: the asking print meets the members of small cells
        met = asks.where(F.col("n") <= cell).join(members, "cell").select("print", F.explode("members").alias("other"))
        near = met.where((F.col("print") != F.col("other")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius))
        near = near.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b"))
        full = asks.where(F.col("n") > cell).select("print")
        found = near if found is None else found.unionByName(near)
        crowded = full if crowded is None else crowded.unionByName(full)
    # a print takes the linear way once, however many of its cells are full
    return found.unionByName(_midpoints(crowded.distinct())).distinct()


def _midpoints(prints: DataFrame) -> DataFrame:
    """Links between prints two bits apart or closer, as stars: equal values among 65 filed by each."""
    flips = F.array(*[F.lit(signed(x)) for x in [0, *[1 << i for i in range(64)]]])
    filed = prints.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("value"))
    # at most 65 prints file a value: those within one bit of it
    groups = filed.groupBy("value").agg(F.min("print").alias("a"), F.collect_list("print").alias("members")).where(F.size("members") > 1)
    return groups.select("a", F.explode("members").alias("b")).where("a <> b")


def components(nodes: DataFrame, links: DataFrame, value: str = "low", rounds: int = 60) -> DataFrame:
    """Smallest ``value`` reachable for each node (column ``print``); links are (a, b).

    Alternating star contraction: each round links all neighbours of a node, and the node, to the
    smallest of them, until nothing changes. A round is a shuffle of at most as many rows as there
    are links; every result is written to the shared folder. Hubs are joined by broadcast.
    """
    links = staged(links, "links")
    if not (many := links.count()):
        return nodes.select("print", F.col(value).alias("component"))
    state = None
    for _ in range(rounds):
        large = _stars(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * many, larger_only=True)
        small = staged(_stars(large.select(F.col("b").alias("a"), F.col("a").alias("b")), many, larger_only=False), "links")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        links = small
        if now == state:
            break
        state, many = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    root = nodes.join(links.select(F.col("b").alias("print"), "a"), "print", "left").select("print", value, F.coalesce("a", "print").alias("root"))
    lows = root.groupBy("root").agg(F.min(value).alias("component"), F.count(F.lit(1)).alias("n"))
    return counted_join(root.select("print", "root"), lows, "root", many).select("print", "component")


def _stars(edges: DataFrame, many: int, larger_only: bool) -> DataFrame:
    """For each a with neighbours b, m = min(a, neighbours): links (m, b) of larger neighbours b > a,
    or of all neighbours and a itself."""
    low = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = counted_join(edges, low, "a", many)
    if larger_only:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links of ``radius`` bits or fewer, the row's own
    included; null keys name no component unless all are null. Rows with null or wordless text have
    fingerprint zero and link like any other; repeated rows give repeated rows; an empty table none.
    """
    rows = staged(with_fingerprint(docs, key=key, text=text, shingle=shingle), "prints")
    nodes = staged(rows.groupBy("print").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    known = components(nodes, links_between(nodes.select("print"), radius)).join(nodes.select("print", "n"), "print")
    # a print of very many rows - no text, or one text copied often - meets its component by broadcast
    return counted_join(rows, known, "print", rows.count()).select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- near duplicates by similarity -----------------------------------------------------------------


_words: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    if (found := _words.get(word)) is None:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(_words) > 150_000:
            _words.clear()
        if len(word) <= 40:
            _words[word] = found
    return found


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of five-word shingles, sorted; of a text up to five words the one of all; none without words."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_word, words), dtype=np.uint64, count=len(words))
    k = min(WIDE, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):  # mixed word by word, so that their order counts
        out = (out ^ codes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def block_prints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each block's sample, told apart by block; blocks without shingles have none."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    block = (shingles >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)
    first = np.searchsorted(block, np.arange(BLOCKS))
    chosen = np.arange(len(block)) - first[block] < SAMPLE
    at, taken = block[chosen], shingles[chosen]
    bits = np.unpackbits(taken.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    present, starts = np.unique(at, return_index=True)
    votes = np.add.reduceat(bits, starts, axis=0)
    sizes = np.diff(np.append(starts, len(at)))[:, None]
    prints = np.packbits(votes * 2 > sizes, axis=1).view(">u8").ravel().astype(np.uint64)
    return (prints ^ (present.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def row_key(docs: DataFrame, key: str, text: str) -> F.Column:
    """What tells rows apart: the key, which may be null or repeated, the text, and the whole row."""
    return F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("key"), F.xxhash64(text).alias("text"), F.xxhash64(*quoted(docs.columns)).alias("row"))


def usual_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and how many of a sample do."""
    draw = F.pmod(F.xxhash64(text, F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(draw < min(1.0, ORDER_TEXTS / max(1, docs.count()))).select(F.col(text).alias("t")).distinct()

    def run(batch: pa.RecordBatch) -> dict:
        return {"shingle": pa.array(np.concatenate([shingle_set(t) for t in columns_of(batch, "t")[0]]).view(np.int64))}

    counts = map_batches(sample, run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= USUAL)
    found = counts.orderBy(F.desc("n"), "shingle").limit(USUAL_MOST).toPandas()
    values = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["n"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, usual: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of the set, unusual ones before usual ones: as many as leave too few for ``SIMILARITY``.

    A set of that similarity shares at least ``least`` shingles; the first of these in the order has ``least - 1`` behind
    it in either set, so it stands in both prefixes.
    """
    least = int(np.ceil(SIMILARITY * len(shingles) - 1e-9))
    many = len(shingles) - least + 1 if len(shingles) else 0
    values, counts = usual
    if not len(values):
        return shingles[:many]
    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    known = values[at] == shingles
    first = shingles[~known][:many]
    if len(first) == many:
        return first
    last = shingles[known][np.argsort(counts[at[known]], kind="stable")]
    return np.concatenate([first, last[: many - len(first)]])


def wide_prints(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """own (``row_key``), node (a hash of the shingle set), size, print, blocks, prefix and the set as 32-bit
    numbers, of every row, staged."""
    rows = docs.select(row_key(docs, key, text).alias("own"), F.col(text).alias("t"))
    usual = docs.sparkSession.sparkContext.broadcast(usual_shingles(docs, text))

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t) for t in columns_of(batch, "t")[0]]
        return {
            "own": batch.column(0),
            "node": pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
            "size": pa.array(map(len, sets), pa.int32()),
            "print": pa.array([signed(majority(s)) for s in sets], pa.int64()),
            "blocks": pa.array(map(block_prints, sets), pa.list_(pa.int64())),
            "prefix": pa.array([prefix(s, usual.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
            "set": pa.array([(s >> np.uint64(32 - BLOCK_BITS)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
        }

    return staged(map_batches(rows, run, f"own {rows.schema['own'].dataType.simpleString()}, node long, size int, print long, blocks array<long>, prefix array<long>, set binary"), "shingles")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``SIMILARITY`` or more, staged."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
            shared = len(np.intersect1d(x, y))
            if shared >= SIMILARITY * (len(x) + len(y) - shared):
                found.append(i)
        kept = batch.take(pa.array(found, pa.int32()))
        return {"a": kept.column(0), "b": kept.column(1)}

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return staged(map_batches(both, run, "a long, b long"), "links")


class AskedSets:
    """Some sets as one sorted list of members, against which another set is counted in one step."""

    def __init__(self, sets: list[np.ndarray]):
        numbers = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate([*sets, np.zeros(0, np.uint32)])
        order = np.argsort(values, kind="stable")
        self.values, self.numbers = values[order], numbers[order]
        self.sizes = np.array([len(s) for s in sets])

    def similar(self, other: np.ndarray) -> np.ndarray:
        """Numbers of the sets with a similarity of ``SIMILARITY`` or more to ``other``."""
        first, last = np.searchsorted(self.values, other, "left"), np.searchsorted(self.values, other, "right")
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.numbers[at], minlength=len(self.sizes))
        return np.flatnonzero((shared >= SIMILARITY * (self.sizes + len(other) - shared)) & (shared > 0))


def in_chunks(rows: DataFrame, sets: DataFrame, many: int) -> DataFrame:
    """Nodes (cell, node, component, size) of each cell as chunks: cell, chunk, nodes (a list of node, component, set), of
    about ``CHUNK`` nodes and ``CHUNK_SIZE`` shingles at most. many: rows, about."""
    cells = rows.groupBy("cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / CHUNK_SIZE)).alias("chunks"))
    dealt = split_join(rows, cells, "cell", many).select("cell", F.pmod(F.xxhash64("node", F.lit(7)), F.greatest("chunks", F.lit(1))).alias("chunk"), "node", "component")
    return dealt.join(sets, "node").groupBy("cell", "chunk").agg(F.collect_list(F.struct("node", "component", "set")).alias("nodes"))


def met_in_chunks(members: DataFrame, asks: DataFrame) -> DataFrame:
    """Verified links between nodes of ``members`` and of ``asks`` (both ``in_chunks``) in a cell, of other components, staged.

    A row is one chunk of each, so that a pair is a number inside a task, never a row, and a chunk is sent once for each
    chunk that it meets, not for each node. Few rows make a batch: each carries many sets.
    """
    both = members.select("cell", F.col("nodes").alias("met")).join(asks.select("cell", "chunk", F.col("nodes").alias("asked")), "cell").select("met", "cell", "chunk", "asked")

    def lists(chunk: pa.ListScalar) -> tuple[list[int], list[int], list[np.ndarray]]:
        rows = chunk.values
        return rows.field("node").to_pylist(), rows.field("component").to_pylist(), [np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in rows.field("set")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ids = theirs = table = None
        for batch in batches:
            met, cells, chunks, asked = (batch.column(i) for i in range(4))
            out: dict[str, list] = {"a": [], "b": []}
            for i in range(batch.num_rows):
                if (key := (cells[i].as_py(), chunks[i].as_py())) != last:
                    ids, theirs, sets = lists(asked[i])
                    last, table = key, AskedSets(sets)
                for node, part, own in zip(*lists(met[i])):
                    for j in table.similar(own).tolist():
                        if theirs[j] != part:
                            out["a"].append(min(node, ids[j]))
                            out["b"].append(max(node, ids[j]))
            if out["a"]:
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return staged(both.mapInArrow(run, "a long, b long"), "links", ROWS_OF_CHUNKS)


def similar_links(nodes: DataFrame, rows: DataFrame, asking: int = ASKING) -> DataFrame:
    """Links (a, b): their components are those of all verified pairs that share a block, or nearly: ``missed_links`` finds the rest.

    First a few nodes of each cell (a block's print) are compared with all its others, which joins most groups of
    copies. Then, in cells whose nodes are not all known to be joined, every node outside of the cell's largest
    component that has not asked yet is compared with the nodes of other components. At the end every pair of a cell is
    compared or known to be joined.
    """
    # prints this far apart, or sizes, cannot belong to a pair of that similarity (beyond chance of 1 in 10,000)
    fits = (F.least("size", "other") >= SIMILARITY * F.greatest("size", "other")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("there"))) <= FAR)
    filed = nodes.select("node", "size", "print", F.explode("blocks").alias("cell"))
    cells = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(split_join(filed, cells, "cell", BLOCKS * nodes.count()), "cells")
    inside = staged(members.select(F.col("node").alias("print")).distinct(), "nodes")
    wanted = nodes.join(inside.withColumnRenamed("print", "node"), "node", "left_semi").select("own")
    # one row of each node that has a candidate; rows are found by what tells them apart, so no node is a hot key
    sets = staged(rows.join(wanted, "own", "left_semi").select("node", "set").dropDuplicates(["node"]), "sets")
    many = members.count()
    # the few that ask are the same in all cells of a node, so that their pairs coincide
    chance = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    ask = staged(members.where(chance * F.col("n") < asking).select("cell", F.col("node").alias("asks"), F.col("size").alias("other"), F.col("print").alias("there")), "asks")
    met = members.join(ask, "cell").where("node <> asks").where(fits)
    links = alike(staged(met.select(F.least("node", "asks").alias("a"), F.greatest("node", "asks").alias("b")).distinct(), "pairs"), sets)
    labels = components(inside, links, "print").withColumnRenamed("print", "node")
    now = staged(members.drop("n").join(labels, "node"), "cells")
    parts = now.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("cell").agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    open_ = staged(split_join(now, largest, "cell", many), "open")
    outside = staged(open_.where("component <> most").select("cell", "node", "component", "size").join(ask.select("cell", F.col("asks").alias("node")), ["cell", "node"], "left_anti"), "outside")
    if outside.isEmpty():
        return links
    meeting = staged(split_join(open_.select("cell", "node", "component", "size"), outside.select("cell").distinct(), "cell", many, "left_semi"), "meeting")
    return links.unionByName(met_in_chunks(in_chunks(meeting, sets, many), staged(in_chunks(outside, sets, many), "asks")))


def sets_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node and set of the nodes in ``wanted``, staged; rows are found by what tells them apart, so no node is a hot key."""
    own = nodes.join(wanted.distinct(), "node", "left_semi").select("own")
    return staged(rows.join(own, "own", "left_semi").select("node", "set").dropDuplicates(["node"]), "sets")


def missed_links(nodes: DataFrame, rows: DataFrame, labels: DataFrame, cell: int = SHARED_CELL) -> DataFrame:
    """Links (a, b) of nodes in different components (labels: node, component): with them, components are those of all
    pairs of ``SIMILARITY``, whether they share a block or not.

    Such pairs share a shingle of their prefixes. In each shingle's cell, the nodes outside of the cell's largest
    component are compared with those of other components: pair by pair in small cells, if they share cells enough, and in
    chunks in fuller ones, where cells of the same largest component are taken together, as their nodes are much the same.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies are filed once by a task, or nearly
        for batch in slices(batches):
            if len(seen) > 500_000:
                seen.clear()
            at = [i for i, node in enumerate(batch.column(0).to_pylist()) if not (node in seen or seen.add(node))]
            kept = batch.take(pa.array(at, pa.int32()))
            lists = kept.column(1)
            yield pa.RecordBatch.from_pydict({"cell": lists.flatten(), "node": kept.column(0).take(pc.list_parent_indices(lists))})

    # a shingle of one node only meets none
    every = Window.partitionBy("cell")
    filed = rows.select("node", "prefix").mapInArrow(file, "cell long, node long")
    filed = filed.select("cell", "node", F.min("node").over(every).alias("low"), F.max("node").over(every).alias("high")).where("low < high").select("cell", "node").distinct()
    known = staged(filed.join(nodes.select("node", "size").join(labels, "node"), "node"), "shared")
    parts = known.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("cell").agg(F.max(F.struct("n", "component"))["component"].alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    many = known.count()
    open_ = staged(split_join(known, largest, "cell", many), "meeting")
    small = open_.where(F.col("n") <= cell)
    asks = small.where("component <> most").select("cell", F.col("node").alias("asks"), F.col("size").alias("other"), F.col("component").alias("part"))
    # a pair once in each cell that it shares
    met = small.join(asks, "cell").where("component <> part").where("component = most or node < asks").where(F.least("size", "other") >= SIMILARITY * F.greatest("size", "other"))
    met = met.groupBy(F.least("node", "asks").alias("a"), F.greatest("node", "asks").alias("b"), F.least("size", "other").alias("less"), F.greatest("size", "other").alias("more")).agg(F.count(F.lit(1)).alias("n"))
    # of two sets, that whose prefix ends first has no shared shingle before that end but those of both prefixes: no more are
    # shared than these and its others. Pairs with a shingle in a full cell, not counted here, are compared there
    least = F.ceil(SIMILARITY * F.col("more") - 1e-9)
    pairs = staged(met.where(F.col("n") + least - 1 >= SIMILARITY / (1 + SIMILARITY) * (F.col("less") + F.col("more")) - 1e-6).select("a", "b"), "pairs")
    links = alike(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, rows))
    full = open_.where(F.col("n") > cell).select(F.col("most").alias("cell"), "node", "component", "size").distinct()
    if full.isEmpty():
        return links
    full = staged(full, "full")
    sets = sets_of(full.select("node"), nodes, rows)
    return links.unionByName(met_in_chunks(in_chunks(full, sets, many), staged(in_chunks(full.where("component <> cell"), sets, many), "asks")))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", asking: int = ASKING) -> DataFrame:
    """Rows of ``docs``, columns as they are, one of each group of near duplicates: that with the smallest
    key, rows without key last.

    Rows are told apart by key, text and all other columns, so that null and repeated keys do no harm: a
    row whose text has no near duplicate always stays, and of rows that are equal altogether one does.
    Null and wordless texts are copies of each other. An empty table gives none.
    """
    rows = wide_prints(docs, key=key, text=text)
    nodes = staged(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("print").alias("print"), F.first("blocks").alias("blocks"), F.min("own").alias("own"), F.count(F.lit(1)).alias("n")), "nodes")
    links = similar_links(nodes, rows, asking)
    labels = staged(components(nodes.select(F.col("node").alias("print")), links, "print").withColumnRenamed("print", "node"), "labels")
    more = missed_links(nodes, rows, labels)
    if not more.isEmpty():
        part = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
        between = more.join(part("a"), "a").join(part("b"), "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
        joined = components(labels.select(F.col("component").alias("print")).distinct(), between, "print").select(F.col("print").alias("was"), F.col("component").alias("now"))
        labels = split_join(labels.withColumnRenamed("component", "was"), joined.where("was <> now"), "was", labels.count(), "left").select("node", F.coalesce("now", "was").alias("component"))
    best = nodes.select("node", "own").join(labels, "node").groupBy("component").agg(F.min("own").alias("own"))
    keep = best.select(F.col("own.row").alias("__factloom_row"))
    columns = quoted(docs.columns)
    found = docs.withColumn("__factloom_row", F.xxhash64(*columns)).join(keep, "__factloom_row", "left_semi")
    # rows equal altogether: one stays; equal ones meet on the way, before the shuffle
    once = found.groupBy("__factloom_row", F.xxhash64(F.lit(1), *columns)).agg(F.first(F.struct(*columns)).alias("__factloom_it"))
    return once.select(*[F.col("__factloom_it")[c].alias(c) for c in docs.columns])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: ``near_duplicates`` at its production parameters."""
    return near_duplicates(read(spark, sf_dir, "documents"))
