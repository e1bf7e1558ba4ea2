"""Graph operators over edge DataFrames: adjacency, reach, neighbours, Personalized PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KIND_WEIGHTS, REVERSE_WALKED, UNKNOWN_KIND_WEIGHT
from .stage import cut


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair])
    return F.coalesce(table[kind], F.lit(UNKNOWN_KIND_WEIGHT))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, kind, w: weight x kind weight; undirected and reverse-walked edges both ways; rows sum to 1."""
    w = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "directed", (F.col("weight") * kind_weight(F.col("kind"))).alias("w"))
    back = w.where(~F.col("directed") | F.col("kind").isin(*REVERSE_WALKED)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "directed", "w")
    both = w.unionByName(back).where("w > 0")
    return both.select("src", "dst", "kind", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("w"))


def reachable(adj: DataFrame, seeds: DataFrame, hops: int = 3, per: tuple[str, ...] = ()) -> DataFrame:
    """node, depth of all nodes within ``hops`` out-edges of the seeds (column node), for each value of ``per``.

    Steps are joined without a visited set, and the smallest depth of each node taken at the end: one
    plan, as the number of hops is small.
    """
    step = seeds.select(*per, "node").distinct()
    out = adj.select("src", "dst").distinct()
    seen = step.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        step = step.withColumnRenamed("node", "src").join(out, "src").select(*per, F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(step.withColumn("depth", F.lit(depth)))
    return seen.groupBy(*per, "node").agg(F.min("depth").alias("depth"))


def neighbors(edges: DataFrame, seed: str, hops: int = 2, min_weight: float = 0.0, kinds: tuple[str, ...] = (), most: int = 200) -> DataFrame:
    """node, depth, weight: symmetric edges both ways, directed ones forward; of equal depths the largest
    product of weights, then the smallest parent."""
    e = edges.where(F.col("weight") >= min_weight)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    one = e.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight").unionByName(e.where(~F.col("directed")).select(F.col("dst_id").alias("src"), F.col("src_id").alias("dst"), "weight"))
    seen = edges.sparkSession.createDataFrame([(seed, 0, 1.0)], "node string, depth int, weight double")
    front = seen
    for depth in range(1, hops + 1):
        step = front.select(F.col("node").alias("src"), F.col("weight").alias("so_far")).join(one, "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("so_far") * F.col("weight")).alias("weight"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "weight"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0").orderBy("depth", F.desc("weight"), "node").limit(most)


#: Edges up to which a universe's adjacency is joined by broadcast.
SMALL_GRAPH = 500_000
#: Rounds between checkpoints.
CUT_EVERY = 10


def pagerank(adj: DataFrame, seeds: DataFrame, *, alpha: float = 0.15, rounds: int = 20, hops: int = 3, tolerance: float | None = 1e-6, more: DataFrame | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """node, rank from seeds (node, p; p sums to 1), over the nodes within ``hops``, and ``more`` (node).

    next = alpha p + (1 - alpha) (flow along edges inside the universe + leak p): mass of nodes without
    any out-edge leaks to the seeds, mass that would leave the universe is dropped. Such a node is given
    edges to the seeds, so that a round is one join and one aggregation, partial before the shuffle.
    The adjacency is broadcast only up to ``SMALL_GRAPH`` edges; lineage is cut every ``CUT_EVERY``
    rounds, where ``tolerance`` may end the iteration; no rank reaches the driver. With ``per``, columns
    of the seeds, twenty rounds serve a whole batch of queries.
    """
    by = list(per)
    universe = reachable(adj, seeds, hops, per).select(*by, "node")
    if more is not None:
        universe = universe.unionByName(more.select(*by, "node")).distinct()
    base = cut(universe.join(seeds.select(*by, "node", "p"), [*by, "node"], "left").select(*by, "node", F.coalesce("p", F.lit(0.0)).alias("p")))
    start = base.where("p > 0")
    # all out-edges of the universe's nodes; a node without any has one that leads to null
    own = base.select(*by, F.col("node").alias("src")).join(adj.select("src", "dst", "w"), "src", "left")
    inside = own.join(base.select(*by, F.col("node").alias("dst"), F.lit(True).alias("known")), [*by, "dst"], "left")
    sinks, back = inside.where("dst is null").select(*by, "src"), start.select(*by, F.col("node").alias("dst"), F.col("p").alias("w"))
    # the seeds are a stated set, of at most some hundred a query
    leaks = sinks.join(back, by) if by else sinks.crossJoin(F.broadcast(back))
    flows = inside.where("known").select(*by, "src", "dst", "w").unionByName(leaks.select(*by, "src", "dst", "w"))
    flows = cut(flows.groupBy(*by, "src", "dst").agg(((1 - alpha) * F.sum("w")).alias("w")))
    table = F.broadcast(flows) if flows.count() <= SMALL_GRAPH else flows
    teleport = start.select(*by, "node", (alpha * F.col("p")).alias("mass"))
    rank = last = start.select(*by, "node", F.col("p").alias("rank"))
    for n in range(1, rounds + 1):
        flow = rank.withColumnRenamed("node", "src").join(table, [*by, "src"]).select(*by, F.col("dst").alias("node"), (F.col("rank") * F.col("w")).alias("mass"))
        rank = flow.unionByName(teleport).groupBy(*by, "node").agg(F.sum("mass").alias("rank"))
        if n % CUT_EVERY == 0 and n < rounds:
            rank = cut(rank)
            if tolerance is not None:
                both = rank.join(last.withColumnRenamed("rank", "was"), [*by, "node"], "full")
                # the move of several rounds bounds that of the last one
                moved = both.agg(F.max(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
                if moved is None or moved < tolerance:
                    break
            last = rank
    return base.join(rank, [*by, "node"], "left").select(*by, "node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def hot_modules(rank: DataFrame, modules: DataFrame, top: int = 3) -> DataFrame:
    """The modules (node) of the largest positive rank, ties by the larger id: node."""
    return rank.join(modules.select("node"), "node", "left_semi").where("rank > 0").orderBy(F.desc("rank"), F.desc("node")).limit(top).select("node")


def drilled(adj: DataFrame, rank: DataFrame, modules: DataFrame, children: DataFrame, seeds: DataFrame, *, top: int = 3, child_weight: float = 0.6, **how) -> DataFrame:
    """Re-ranks with the children of the hottest modules; ``rank`` itself where they add no node.

    children (src: module, dst: child) join the universe, edges from module to child the adjacency, and
    those modules' rows are made to sum to 1 again.
    """
    hot = cut(hot_modules(rank, modules, top))
    added = cut(children.join(hot.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
    if added.join(rank.select(F.col("node").alias("dst")), "dst", "left_anti").isEmpty():
        return rank
    both = adj.select("src", "dst", "w").unionByName(added.select("src", "dst", F.lit(child_weight).alias("w")))
    touched = hot.select(F.col("node").alias("src"), F.lit(True).alias("touched"))
    total = F.sum("w").over(Window.partitionBy("src"))
    again = both.join(F.broadcast(touched), "src", "left").select("src", "dst", F.when(F.col("touched"), F.col("w") / total).otherwise(F.col("w")).alias("w"))
    return pagerank(cut(again), seeds, more=added.select(F.col("dst").alias("node")).unionByName(rank.select("node")), **how)


def provenance(adj: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """node, depth, via (edge kind), parent: the first reach in breadth-first order, by parent and kind."""
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("parent"))
    front = seen
    for depth in range(1, hops + 1):
        step = front.select(F.col("node").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.col("src"), F.col("kind"))).alias("m"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.col("m.kind").alias("via"), F.col("m.src").alias("parent")))
        seen = seen.unionByName(front)
    return seen


def trail(depth: Column, via: Column) -> Column:
    return F.when(depth == 0, "seed").otherwise(F.concat(depth.cast("string"), F.lit("-hop via "), via))
