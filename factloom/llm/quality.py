"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Target text is what the labels call good (quality 1, not toxic). Raw text is all documents, a mixture of
target text and two other components, toxic and low-quality text. Each part is a model of which hashed
n-grams a document has: unigrams, bigrams and word beginnings, plus how much of it repeats the word before.
The labelled sample gives a first model of each part; by it every document of the corpus is told to its part,
and the counts of all documents, not of the sample, make the models that weigh (one step of hard
expectation maximisation, so that what is counted grows with the input). A bucket counts as equally likely in
target and component - the models are tied there - unless it is more frequent in the component by a factor of
e at a high z score, so that neither common nor rare words add up to a verdict.

A document's log ratio to a component, less the component's cut, is its margin. Its importance is target over
raw, w = 1 / (pi + sum of pi_c exp(-margin_c)); k documents are drawn without replacement in proportion to a
power of w: those with the largest log w / temperature + Gumbel(document). k is the number of documents, of all,
with a positive margin to every component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import words
from .common import columns_of, map_batches, quoted, read, slices, staged

BUCKETS = 1 << 18
#: Labelled rows that fit the models, about (a hash sample).
LABELLED = 20_000
PSEUDO = 4.0
#: z score that a bucket needs when as many documents as LABELLED are counted; in proportion to the
#: root of the sample below, so that it asks for the same effect at every size, but 5 at least.
Z = 12.0
#: Documents are drawn in proportion to w ** (1 / TEMPERATURE): 1 follows the importance itself, small
#: values leave little to chance.
TEMPERATURE = 0.05
#: What losing a good document weighs against keeping another when a cut is set.
GOOD_WEIGHT = 3.0
COMPONENTS = ("toxic", "low")
#: Of the labelled sample, the share that sets the cut instead of counts.
TUNE_PARTS = 5
#: Bins of the distribution of keys, from which the k-th largest is found.
BINS = 4096

_SEED = np.uint64(0x9E3779B97F4A7C15)


def buckets_of(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct buckets, in order, of the n-grams of each whole text."""
    found = []
    for n, owner, one, stem in words.coded(texts):
        one, owned = one.astype(np.uint64), owner.astype(np.uint32) << np.uint32(18)
        inside = owner[1:] == owner[:-1]
        pairs = np.bincount(owner[1:][inside], minlength=n)
        again = np.bincount(owner[1:][inside & (one[1:] == one[:-1])], minlength=n)
        repeated = (10 * (again / np.maximum(pairs, 1))).astype(np.int64)
        level = np.arange(repeated.sum()) - np.repeat(repeated.cumsum() - repeated, repeated)
        two = (one[:-1] * np.uint64(31) + one[1:] + np.uint64(1 << 40))[inside]
        every = np.concatenate([one, stem + np.uint64(1 << 41), two, level.astype(np.uint64) + np.uint64(1 << 42)])
        of = np.concatenate([owned, owned, owned[1:][inside], np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(18), repeated)])
        keys = of | ((every * _SEED) >> np.uint64(46)).astype(np.uint32)
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        at = (keys & np.uint32(BUCKETS - 1)).astype(np.int64)
        found += np.split(at, np.searchsorted(keys, np.arange(1, n, dtype=np.uint32) << np.uint32(18)))
    return found


def _share(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


class Model:
    """Frozen log ratios and cuts to each component, and the mixture's shares."""

    def __init__(self, sizes: dict[str, int], signs: dict[str, tuple[np.ndarray, np.ndarray, float]]):
        """sizes: documents of ``good`` and each component; signs: buckets that tell a component, their log
        ratios, and the mean log ratio of a target document's buckets."""
        total = max(1, sum(sizes.values()))
        self.parts = list(signs)
        self.shares = np.array([max(0.01, sizes.get(c, 0) / total) for c in ("good", *self.parts)])
        self.shares /= self.shares.sum()
        self.cuts = np.zeros(len(self.parts))
        self.ratios = np.zeros((len(self.parts), BUCKETS), dtype=np.float32)
        for i, (at, ratio, usual) in enumerate(signs.values()):
            self.ratios[i, at] = ratio
            # less what a target document of as many buckets holds by chance: long texts are no worse
            self.ratios[i] -= usual

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Log ratio to each component less its cut, of each whole text; without n-grams -cut."""
        return self.margins_of(buckets_of(texts))

    def margins_of(self, buckets: list[np.ndarray]) -> np.ndarray:
        found = [[r.take(b).sum(dtype=np.float64) for r in self.ratios] for b in buckets]
        return np.array(found).reshape(len(buckets), len(self.parts)) - self.cuts

    def log_weight(self, margins: np.ndarray) -> np.ndarray:
        terms = np.concatenate([np.full((len(margins), 1), np.log(self.shares[0])), np.log(self.shares[1:]) - margins], axis=1)
        return -np.logaddexp.reduce(terms, axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", bound: int = LABELLED) -> DataFrame:
    """kind (good, toxic or low), tune, text of a hash sample of about ``bound`` labelled documents.

    Rows with a null id, text, quality or toxic teach nothing; of labels that repeat an id the worst
    of each judgement holds.
    """
    judged = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    n = judged.count()
    judged = judged.where(_share(key, F.lit(11)) < min(1.0, bound / max(1, n)))
    judged = judged.groupBy(F.col(key).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    # the sample is bounded by its hash share: about ``bound`` ids
    rows = chosen.join(F.broadcast(judged), "id")
    kind = F.when(F.col("toxic") != 0, "toxic").when(F.col("quality") == 1, "good").otherwise("low")
    once = rows.select(kind.alias("kind"), "text").groupBy(F.xxhash64("text").alias("same")).agg(F.max("kind").alias("kind"), F.first("text").alias("text"))
    return once.select("kind", (_share("same", F.lit(12)) < 1 / TUNE_PARTS).alias("tune"), "text")


def signs_of(counts: DataFrame, part: str, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets whose models are not tied between target and ``part``; only these reach the driver."""
    a, b, n = F.col("good"), F.col(part), F.col("good") + F.col(part)
    pi = sizes["good"] / (sizes["good"] + sizes[part])
    z = (b - n * (1 - pi)) / F.sqrt(n * (pi * (1 - pi)))
    ratio = F.log((a + PSEUDO * pi) / (b + PSEUDO * (1 - pi))) - float(np.log(pi / (1 - pi)))
    least = max(5.0, Z * (sum(sizes.values()) / LABELLED) ** 0.5)
    found = counts.where(n > 0).select("at", "good", ratio.alias("ratio"), z.alias("z")).where((F.col("z") >= least) & (F.col("ratio") < -1)).collect()
    total = counts.agg(F.sum("good")).first()[0] or 1.0
    at, ratios = np.array([r["at"] for r in found], dtype=np.int64), np.array([r["ratio"] for r in found])
    return at, ratios, float((ratios * np.array([r["good"] for r in found])).sum() / total)


KINDS = ("good", *COMPONENTS)


def _tuned(model: Model, tune: DataFrame) -> Model:
    """The model with cuts set on the tuning share."""
    frozen = tune.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        kinds, texts = columns_of(batch, "kind", "text")
        return {"kind": kinds, "m": pa.array(frozen.value.margins(texts).tolist(), pa.list_(pa.float64()))}

    tuned = map_batches(tune, score, "kind string, m array<double>").collect()
    for i, part in enumerate(model.parts):
        own = [r for r in tuned if r["kind"] in ("good", part)]
        model.cuts[i] = best_cut(np.array([r["m"][i] for r in own]), np.array([r["kind"] == "good" for r in own], dtype=bool))
    return model


def _modelled(sums: DataFrame) -> Model:
    """A model from bucket counts (kind, at, n); bucket -1 counts the documents. The driver gets the telling buckets."""
    counts = staged(sums.groupBy("at").agg(*[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).cast("double").alias(k) for i, k in enumerate(KINDS)]), "counts")
    whole = counts.where("at = -1").first()
    sizes = {k: int(whole[k]) for k in KINDS} if whole else {}
    return Model(sizes, {c: signs_of(counts.where("at >= 0"), c, sizes) for c in COMPONENTS if sizes.get(c) and sizes.get("good")})


def fit(docs: DataFrame, labels: DataFrame, **names) -> Model:
    """Models from the labelled sample, then from all documents as these tell them apart.

    Buckets are counted on the executors, summed and compared by Spark; the driver gets the telling buckets.
    Cuts are set on the tuning share of the sample. Without good or without other labels every document passes.
    """
    sample = staged(labelled_sample(docs, labels, **names), "labelled")
    tune = sample.where("tune")

    def taught(batches):
        for batch in slices(batches):
            by: dict[str, list] = {}
            kinds, texts = columns_of(batch, "kind", "text")
            for kind, buckets in zip(kinds, buckets_of(texts)):
                by.setdefault(kind, []).append(buckets)
            for kind, found in by.items():
                at, n = np.unique(np.concatenate([*found, np.full(len(found), -1)]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at), KINDS.index(kind)), pa.int32()), "at": at, "n": n})

    first = _tuned(_modelled(sample.where("NOT tune").mapInArrow(taught, "kind int, at long, n long")), tune)
    if not first.parts:
        return first
    frozen = sample.sparkSession.sparkContext.broadcast(first)

    def told(batches):
        # one table of counts a task, whatever its number of documents
        found = np.zeros((len(KINDS), BUCKETS), dtype=np.int64)
        whole = np.zeros(len(KINDS), dtype=np.int64)
        numbers = [0, *[KINDS.index(c) for c in first.parts]]
        for batch in slices(batches):
            each = buckets_of(columns_of(batch, "t")[0])
            margins = frozen.value.margins_of(each)
            for buckets, m in zip(each, margins):
                kind = numbers[1 + int(m.argmin())] if m.min() <= 0 else 0
                found[kind][buckets] += 1
                whole[kind] += 1
        for kind in range(len(KINDS)):
            if whole[kind]:
                at = np.flatnonzero(found[kind])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(at) + 1, kind), pa.int32()), "at": np.append(at, -1), "n": np.append(found[kind, at], whole[kind])})

    text = names.get("text", "text")
    corpus = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(told, "kind int, at long, n long")
    return _tuned(_modelled(corpus), tune)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Cut with the largest weighted true minus false acceptance rate, in the middle of the gap; keeps all
    where a kind is missing."""
    if not good.any() or good.all():
        return float(scores.min(initial=0)) - 1
    at = np.unique(scores)
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    kept_good = 1 - np.searchsorted(np.sort(scores[good]), cuts) / good.sum()
    kept_bad = 1 - np.searchsorted(np.sort(scores[~good]), cuts) / (~good).sum()
    gain = GOOD_WEIGHT * kept_good - kept_bad
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(cuts[best[len(best) // 2]])


def scored(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``carry`` columns, default all), __score, __log_weight and __key (log
    weight + Gumbel noise of id and text) of each row."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*quoted(carry or docs.columns)).alias("row"), F.col(text).alias("t"), _share(F.col(key), F.col(text), F.lit(13)).alias("u"))

    def run(batches):
        for batch in slices(batches):
            texts, draws = columns_of(batch, "t", "u")
            margins = frozen.value.margins(texts)
            score = margins.min(axis=1) if margins.shape[1] else np.full(len(margins), np.inf)
            weight = frozen.value.log_weight(margins)
            gumbel = -np.log(-np.log(np.array(draws) + 0.5 / (1 << 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(weight), pa.array(weight / TEMPERATURE + gumbel)], names=["row", "__score", "__log_weight", "__key"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), *[StructField(n, DoubleType()) for n in ("__score", "__log_weight", "__key")]])
    return rows.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of a column ``x``, by counting bins and narrowing them: never a global sort."""
    low, high = keys.agg(F.min("x"), F.max("x")).first()
    if low is None or k <= 0:
        return float("inf")
    wanted = k
    while high > low:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        inside = keys.where(F.col("x").between(low, high))
        at = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if wanted <= n:
                break
            wanted -= n
        if n == wanted:
            return lo
        low, high = lo, hi
    return low


def sampled(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", k: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Gumbel top-k of ``docs``: rows of ``scored``, k of them (ties all stay).

    k defaults to the number of documents with a positive margin to every component. Null and empty
    texts have no n-grams and score like text without any sign; repeated rows draw the same noise and go or stay together; an empty table gives none.
    """
    # texts are scored once; the k-th key is then found from one staged column
    every = staged(scored(docs, model, key=key, text=text, carry=carry), "scored")
    if k is None:
        k = every.where(F.col("__score") > 0).count()
    least = kth_largest(every.select(F.col("__key").alias("x")), k)
    return every.where(F.col("__key") >= least)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, columns as they are, that the resampling draws."""
    return sampled(docs, fit(docs, labels)).select("row.*")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (smallest margin), log_weight, sample_key of the drawn documents."""
    docs = read(spark, sf_dir, "documents")
    found = sampled(docs, fit(docs, read(spark, sf_dir, "labels")), carry=["doc_id"])
    return found.select("row.doc_id", F.col("__score").alias("score"), F.col("__log_weight").alias("log_weight"), F.col("__key").alias("sample_key"))
