"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes: how often every byte followed every context of up to
``ORDER`` bytes in its training texts. A byte seen after a context costs -log2(n / (total + kinds));
otherwise an escape, -log2(kinds / (total + kinds)), is paid and the next shorter context is asked,
down to a uniform byte (escape method C, without exclusions; contexts never seen cost nothing to
leave). The statistics are frozen once trained, so the cost of a byte is a function of the
``ORDER`` + 1 bytes ending there, and whole texts are scored by table lookups.

The trees of all languages share sorted gram tables, one row of costs per gram with a column per
language. Language, source and id of a scored document are never looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, kept_rows, map_batches, read

#: Bytes of context.
ORDER = 3
#: Labelled documents per language that train its tree, about; whole texts of a hash sample.
TRAIN_DOCS = 1_000
#: Grams of the longest order that occur less often are left to the shorter contexts.
LEAST = 2
#: Bytes scored at once.
CHUNK = 1 << 20
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

_SLOT = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Codes of the grams of ``length`` bytes, by the place where each ends (from length - 1 on)."""
    code = np.zeros(len(data) - length + 1, dtype=np.uint32)
    for i in range(length):
        code <<= np.uint32(8)
        code |= data[i : len(data) - length + 1 + i]
    return code


def joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind ``order`` line feeds each, as one byte array; where each starts and ends."""
    pad = b"\n" * order
    data = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + order) - sizes
    return data, np.stack([starts, starts + sizes], axis=1)


def counted(lang: str, texts: list[bytes], order: int) -> list[tuple[str, int, int, int]]:
    """(language, gram length, gram, count) over texts, for all lengths 1 to order + 1."""
    data, spans = joined(texts, order)
    own = np.zeros(len(data), dtype=bool)
    for a, b in spans:
        own[a:b] = True
    out = []
    for n in range(1, order + 2):
        code, number = np.unique(grams(data, n)[own[n - 1 :]], return_counts=True)
        out += [(lang, n, int(c), int(k)) for c, k in zip(code, number)]
    return out


class Table:
    """Open-addressed gram -> row, in numpy: one probe for nearly all lookups, none for the absent."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        self.spill = np.zeros(0, dtype=np.int64)
        at = self._at(keys)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.slots[at] != np.arange(len(keys)))
        self.spill = lost[np.argsort(keys[lost])]

    def _at(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _SLOT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where absent."""
        if not len(self.keys):
            return np.full(len(codes), -1, dtype=np.int32)
        row = self.slots[self._at(codes)]
        wrong = np.flatnonzero(self.keys[row] != codes)
        if len(wrong):
            row[wrong] = -1
            if len(self.spill):
                kept = self.keys[self.spill]
                i = np.minimum(np.searchsorted(kept, codes[wrong]), len(kept) - 1)
                hit = kept[i] == codes[wrong]
                row[wrong[hit]] = self.spill[i[hit]]
        return row


class Trees:
    """Frozen statistics: per gram length a table of costs in bits, and of escape costs by context."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], order: int):
        """counts: gram length -> (language index, gram, count) arrays."""
        self.langs, self.order = langs, order
        width = len(langs)
        self.cost: dict[int, tuple[Table, np.ndarray]] = {}
        self.escape: dict[int, tuple[Table, np.ndarray]] = {}
        for n in range(1, order + 2):
            lang, gram, number = counts.get(n, (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            context = (gram >> np.uint32(8)).astype(np.uint32)
            contexts, c_at = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, (c_at, lang), number)
            np.add.at(kinds, (c_at, lang), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0).astype(np.float32)
            self.escape[n - 1] = Table(contexts), leave
            keys, g_at = np.unique(gram, return_inverse=True)
            own = np.full((len(keys), width), np.nan, dtype=np.float32)
            own[g_at, lang] = -np.log2(number / (total[c_at, lang] + kinds[c_at, lang]))
            shorter = self._shorter(keys, n)
            self.cost[n] = Table(keys), np.where(np.isnan(own), shorter, own).astype(np.float32)

    def _shorter(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Cost of grams of length n that are not in the tree: escape, then the shorter context."""
        table, leave = self.escape[n - 1]
        row = table.find(codes >> np.uint32(8))
        out = np.where((row >= 0)[:, None], leave[row] if len(leave) else np.float32(0), np.float32(0))
        if n == 1:
            return out + np.float32(8)
        return out + self.bits(codes & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)

    def bits(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Code length of the last byte of each gram of length n, a column per language."""
        table, cost = self.cost[n]
        if not len(cost):
            return self._shorter(codes, n)
        row = table.find(codes)
        out = cost[row]
        absent = np.flatnonzero(row < 0)
        if len(absent):
            out[absent] = self._shorter(codes[absent], n)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Total code length of each whole text, a column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK or i + 1 == len(texts):
                self._chunk(texts[begin : i + 1], out[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _chunk(self, texts: list[bytes], out: np.ndarray) -> None:
        data, spans = joined(texts, self.order)
        for at in range(0, len(data), CHUNK):  # a very long text is scored in parts, each byte once
            part = data[max(0, at - self.order) : at + CHUNK]
            if len(part) <= self.order:
                continue
            first = max(at, self.order)
            cost = self.bits(grams(part, self.order + 1), self.order + 1)
            a, b = np.clip(spans, first, first + len(cost)).T - first
            for k in np.flatnonzero(b > a):
                out[k] += cost[a[k] : b[k]].sum(axis=0, dtype=np.float64)


def held_out(key: str, parts: int = 5) -> F.Column:
    """crc32 of the id as text leaves no remainder. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(True))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS, order: int = ORDER) -> Trees:
    """Context trees from a hash sample of about ``per_lang`` labelled texts that are not held out.

    Rows with null text or lang teach nothing. Grams are counted on the executors and summed by
    Spark; the driver gets the trees, whose size the sample bounds.
    """
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Trees([], {}, order)
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(lang).alias("l"), F.col(text).alias("t"))

    def count(batch: pa.RecordBatch) -> dict:
        by: dict[str, list[bytes]] = {}
        for name, t in zip(*columns_of(batch, "l", "t")):
            by.setdefault(name, []).append(t.encode())
        rows = [r for name, texts in by.items() for r in counted(name, texts, order)]
        names, n, g, k = zip(*rows) if rows else ((), (), (), ())
        return {"l": pa.array(names, pa.string()), "n": pa.array(n, pa.int32()), "g": pa.array(g, pa.int64()), "k": pa.array(k, pa.int64())}

    sums = map_batches(sample, count, "l string, n int, g long, k long").groupBy("l", "n", "g").agg(F.sum("k").alias("k"))
    frame = sums.where((F.col("n") <= order) | (F.col("k") >= LEAST)).toPandas()
    langs = sorted(sizes)
    index = {name: i for i, name in enumerate(langs)}
    frame["i"] = frame["l"].map(index)
    frame = frame.sort_values(["n", "g", "i"], kind="stable")
    counts = {int(n): (f["i"].to_numpy(np.int64), f["g"].to_numpy(np.uint32), f["k"].to_numpy(np.int64)) for n, f in frame.groupby("n")}
    return Trees(langs, counts, order)


def predict_batch(trees: Trees, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its posterior among the learned ones (equal priors) of each whole text.

    Null, letterless and - where nothing was learned - all texts are ``und`` with score 0. Equal
    code lengths go to the language that sorts first.
    """
    own = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if trees.langs else []
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if own:
        bits = trees.score([texts[i].encode() for i in own])
        best = bits.argmin(axis=1)
        weight = 1 / np.exp2(np.minimum(1000, -(bits - bits[np.arange(len(own)), best][:, None])).clip(-1000, 0)).sum(axis=1)
        for i, b, w in zip(own, best, weight):
            langs[i], scores[i] = trees.langs[b], float(min(1.0, w))
    return langs, scores


def identify(docs: DataFrame, trees: Trees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score; repeated rows and null keys pass through."""
    rows = docs.select(F.col(key).alias("k"), held_out(key).alias("h"), F.col(text).alias("t"))
    frozen = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batch: pa.RecordBatch) -> dict:
        keys, held, texts = columns_of(batch, "k", "h", "t")
        langs, scores = predict_batch(frozen.value, texts)
        return {"k": keys, "h": held, "l": langs, "s": scores}

    kind = rows.schema["k"].dataType.simpleString()
    return map_batches(rows, predict, f"k {kind}, h boolean, l string, s double").toDF(key, "held_out", "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a fifth of them, by a checksum of the id, is held out of training."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def accepted(docs: DataFrame, trees: Trees, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, columns as they are, whose language is determined with posterior ``least`` or more."""
    frozen = docs.sparkSession.sparkContext.broadcast(trees)
    return kept_rows(docs, text, lambda texts: [s >= least for s in predict_batch(frozen.value, texts)[1]])
