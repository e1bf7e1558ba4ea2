"""Vector search, relevance gate, token budget, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers (queries x dimensions) up to which a query set is held in every task.
HELD_NUMBERS = 50_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero norm counts as 1; null where the dimensions differ."""
    def norm(v: Column) -> Column:
        n = F.sqrt(dot(v, v))
        return F.when(n == 0, 1.0).otherwise(n)

    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b)))


def matrix_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column as the rows of a matrix of unit length, and which rows they are: those of
    the commonest dimension. A zero vector stays zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
    return lists, sizes


def unit_rows(lists: pa.Array, at: np.ndarray) -> np.ndarray:
    rows = np.array([v for v in lists.take(pa.array(at)).to_pylist()], dtype=np.float64).reshape(len(at), -1)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1.0, norm)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, ident: str, vector: str, query: str = "query_id", digits: int = 6) -> DataFrame:
    """query_id, ident, cosine, rank: the k nearest of each query, ties by id; other dimensions are skipped.

    Vectors are multiplied in blocks with the query set, whose size is checked: larger sets are taken in
    parts. Each block keeps its k best of each query before the shuffle.
    """
    spark = vectors.sparkSession
    asked = [r for r in queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).toLocalIterator() if r["v"] is not None]
    kinds = (queries.schema[query].dataType, vectors.schema[ident].dataType)
    schema = f"q {kinds[0].simpleString()}, i {kinds[1].simpleString()}, cosine double"
    rows = vectors.select(F.col(ident).alias("i"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    part = max(1, HELD_NUMBERS // max([len(r["v"]) for r in asked], default=1))
    found = None
    for first in range(0, len(asked), part):
        by_size: dict[int, tuple[list, list]] = {}
        for r in asked[first : first + part]:
            ids, lists = by_size.setdefault(len(r["v"]), ([], []))
            ids.append(r["q"])
            lists.append(r["v"])
        held = {n: (np.arange(len(ids)), ids, unit_rows(pa.array(lists), np.arange(len(lists)))) for n, (ids, lists) in by_size.items()}
        shared = spark.sparkContext.broadcast(held)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.array(batch.column(0).to_pylist(), dtype=object)
                lists, sizes = matrix_of(batch.column(1))
                for n, (_, names, matrix) in shared.value.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    cosine = np.round(unit_rows(lists, at) @ matrix.T, digits) + 0.0
                    order = np.argsort(ids[at], kind="stable")
                    out = [(names[j], ids[at[i]], float(cosine[i, j])) for j in range(len(names)) for i in order[np.argsort(-cosine[order, j], kind="stable")[:k]]]
                    q, i, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, schema_types[0]), pa.array(i, schema_types[1]), pa.array(c)], names=["q", "i", "cosine"])

        from pyspark.sql.pandas.types import to_arrow_type

        schema_types = tuple(to_arrow_type(t) for t in kinds)
        new = rows.mapInArrow(best, schema)
        found = new if found is None else found.unionByName(new)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "i")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query), F.col("i").alias(ident), "cosine", "rank")


def similarity_for(ids: DataFrame, vectors: DataFrame, query: list[float], *, ident: str, vector: str) -> DataFrame:
    """Cosine of named atoms to the query; -1 where an atom has no vector (unknown is not zero)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return ids.join(vectors, ident, "left").select(ident, F.coalesce(cosine(F.col(vector), q), F.lit(-1.0)).alias("relevance"))


def seeds(scores: DataFrame, exact: DataFrame, *, ident: str = "node") -> DataFrame:
    """Positive similarities and exact matches (1.0), the larger of both, divided by their sum.

    The sum is an aggregate of partial sums, joined back as the one row it is: no window over all rows.
    """
    every = scores.where("score > 0").select(ident, "score").unionByName(exact.select(ident, F.lit(1.0).alias("score")))
    best = every.groupBy(ident).agg(F.max("score").alias("score"))
    whole = best.agg(F.sum("score").alias("__whole"))
    return best.crossJoin(F.broadcast(whole)).select(ident, (F.col("score") / F.col("__whole")).alias("p"))


def gated(hits: DataFrame, floor: float, *, relevance: str = "relevance", scaffolding: str = "scaffolding") -> DataFrame:
    """Adds ``verdict``: scaffolding, suppressed (known relevance under the floor) or kept."""
    return hits.withColumn("verdict", F.when(F.col(scaffolding), "scaffolding").when((F.col(relevance) >= 0) & (F.col(relevance) < floor), "suppressed").otherwise("kept"))


def gate_summary(verdicts: DataFrame, *, relevance: str = "relevance") -> DataFrame:
    """Counts by verdict, the best relevance before the floor, and whether all was silenced."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(n("kept").alias("n_kept"), n("suppressed").alias("n_suppressed"), n("scaffolding").alias("n_scaffolding"), F.max(F.when(F.col("verdict") != "scaffolding", F.col(relevance))).alias("top_relevance"), ((n("kept") == 0) & (n("suppressed") > 0)).alias("silenced"))


def within_budget(rows: DataFrame, *, order: list[str], tokens: str, cap: int, group: list[str] = ()) -> DataFrame:
    """Rows before the first one whose running token sum exceeds ``cap``."""
    along = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("running", F.sum(tokens).over(along))
    return running.withColumn("__over", F.max((F.col("running") > cap).cast("int")).over(along)).where("__over = 0").drop("__over")


def nearest_ranks(values: DataFrame, shares: dict[str, float], *, value: str, group: list[str] = ()) -> DataFrame:
    """Per group n and, by name, the value at the nearest rank of each share, index rounded half to even.

    Values are counted first; ranks are sums of counts per coarse bin, then running counts inside the bins,
    so no list of all values and no sort of all rows is ever in one task.
    """
    keys = list(group)
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    spread = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    joined = counts.join(F.broadcast(spread), keys) if keys else counts.crossJoin(F.broadcast(spread))
    width = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1000)).otherwise(0).cast("int")
    binned = joined.withColumn("bin", width)
    along = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = binned.groupBy(*keys, "bin").agg(F.sum("c").alias("s")).select(*keys, "bin", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = binned.withColumn("upto", F.sum("c").over(inside)).join(before, [*keys, "bin"]).withColumn("upto", F.col("upto") + F.col("before"))
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1)), F.col("v"))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def percentile_nearest(values: Column, p: float) -> Column:
    """Nearest rank of a small array, index rounded half to even."""
    return F.array_sort(values)[F.bround(F.lit(p) * (F.size(values) - 1)).cast("int")]


def calibrated(tops: DataFrame, *, kind: str = "kind", value: str = "value", least: int = 20, embedded: int | None = None, least_embedded: int = 20) -> DataFrame:
    """n_genuine, genuine_p25, nonsense_p95, status, floor from genuine and nonsense tops: the floor is
    n95 + (g25 - n95) / 4. status: insufficient_data under ``least`` genuine tops, without nonsense tops or
    (where ``embedded`` is given) under ``least_embedded`` vectors; not_separable; ok."""
    both = nearest_ranks(tops, {"p25": 0.25, "p95": 0.95}, value=value, group=[kind])
    genuine, nonsense = F.col(kind) == "genuine", F.col(kind) == "nonsense"
    one = both.agg(
        F.coalesce(F.max(F.when(genuine, F.col("n"))), F.lit(0)).cast("int").alias("n_genuine"),
        F.max(F.when(genuine, F.col("p25"))).alias("genuine_p25"),
        F.max(F.when(nonsense, F.col("p95"))).alias("nonsense_p95"),
    )
    few = (F.col("n_genuine") < least) | F.col("nonsense_p95").isNull() | F.lit(embedded is not None and embedded < least_embedded)
    status = F.when(few, "insufficient_data").when(F.col("genuine_p25") <= F.col("nonsense_p95"), "not_separable").otherwise("ok")
    floor = F.bround(F.col("nonsense_p95") + 0.25 * (F.col("genuine_p25") - F.col("nonsense_p95")), 4)
    return one.withColumn("status", status).withColumn("floor", F.when(F.col("status") == "ok", floor))


def query_tops(hits: DataFrame) -> DataFrame:
    """kind, query_id, value: the best known relevance of each query's hits (kind, query_id, topic_key,
    relevance), scaffolding and unknown ones left out; queries without any give no row."""
    from .compose import scaffolding

    known = hits.where((F.col("relevance") >= 0) & ~F.coalesce(scaffolding(F.col("topic_key")), F.lit(False)))
    return known.groupBy("kind", "query_id").agg(F.max("relevance").alias("value"))
