"""Graph, discovery and ranking queries: regions, nations and suppliers are the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, graph, merge
from ..operators.stage import cut
from .registry import query, seconds

PAIRS = """c AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25),
d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN c USING (l_orderkey)),
pairs AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n, least(1.0, count(*) / 10.0)::DOUBLE AS weight FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey
  GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, a, b LIMIT 400)"""

EDGES = f"""{PAIRS}, e AS (
  SELECT 'N' || n_nationkey AS src_id, 'R' || n_regionkey AS dst_id, 'ROLLS_UP' AS kind, true AS directed, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'OWNS', true, 1.0 FROM supplier
  UNION ALL SELECT 'S' || a, 'S' || b, 'CO_CHANGED', false, weight FROM pairs),
w AS (SELECT src_id AS src, dst_id AS dst, kind, directed, weight * CASE kind WHEN 'ROLLS_UP' THEN 0.6 ELSE 0.4 END AS w FROM e),
both_ways AS (SELECT src, dst, kind, w FROM w UNION ALL SELECT dst, src, kind, w FROM w WHERE NOT directed),
adj AS MATERIALIZED (SELECT src, dst, kind, w / sum(w) OVER (PARTITION BY src) AS w FROM both_ways WHERE w > 0)"""


def pairs(t) -> DataFrame:
    return discovery.co_changes(t.lineitem, commit="l_orderkey", file="l_suppkey")


def edges(t) -> DataFrame:
    def named(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    rolls = t.nation.select(named("N", "n_nationkey").alias("src_id"), named("R", "n_regionkey").alias("dst_id"), F.lit("ROLLS_UP").alias("kind"), F.lit(True).alias("directed"), F.lit(1.0).alias("weight"))
    owns = t.supplier.select(named("S", "s_suppkey"), named("N", "s_nationkey"), F.lit("OWNS"), F.lit(True), F.lit(1.0))
    together = pairs(t).select(named("S", "a"), named("S", "b"), F.lit("CO_CHANGED"), F.lit(False), "weight")
    return rolls.union(owns).union(together)


def adjacent(t) -> DataFrame:
    """The adjacency, kept: iterative operators read it many times, and its edges come from a self-join."""
    return cut(graph.adjacency(edges(t)))


@query(f"WITH {PAIRS} SELECT a, b, n, weight FROM pairs")
def co_change_pairs(t):
    return pairs(t)


@query("""WITH s AS (SELECT p_partkey, p_name || '|' || p_type || '|' || p_size AS symbol, p_brand FROM part),
g AS (SELECT symbol, count(*) AS n FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8 AND count(DISTINCT p_brand) >= 2)
SELECT x.p_partkey AS a, y.p_partkey AS b, round_even((0.8 - 0.4 * (n - 2) / 6.0)::DOUBLE, 4) AS weight FROM s x JOIN s y ON x.symbol = y.symbol AND x.p_partkey < y.p_partkey AND x.p_brand <> y.p_brand JOIN g ON g.symbol = x.symbol""")
def mirror_pairs(t):
    symbols = t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string")).alias("symbol"), "p_brand")
    return discovery.mirrors(symbols, ident="p_partkey", symbol="symbol", repo="p_brand").drop("symbol").withColumn("weight", F.col("weight").cast("double"))


HREFS = """m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[A-Za-z0-9]+)"', 1)) AS token FROM pages),
f AS (SELECT page_id, regexp_extract(html, 'href="(/[A-Za-z0-9]+)"', 1) AS token FROM pages WHERE regexp_matches(html, 'href="(/[A-Za-z0-9]+)"'))"""


@query(f"WITH {HREFS}, j AS (SELECT src, token, dst, own, row_number() OVER (PARTITION BY src, token ORDER BY dst) AS n FROM (SELECT DISTINCT m.page_id AS src, m.token, f.page_id AS dst, o.token AS own FROM m JOIN f USING (token) LEFT JOIN f o ON o.page_id = m.page_id)) SELECT src, min(token) AS token, dst FROM j WHERE n <= 8 AND src <> dst AND token IS DISTINCT FROM own GROUP BY src, dst")
def path_references(t):
    pattern = 'href="(/[A-Za-z0-9]+)"'
    declared = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", pattern, 1).alias("path"), F.lit("r").alias("repo_id")).where("path <> ''")
    mentions = t.pages.select(F.col("page_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("token"))
    return discovery.path_references(mentions.join(declared, "id", "left"), declared)


@query("""WITH c AS (SELECT c_nationkey AS directory, o_custkey AS author, count(*) AS n, max(epoch_us(o_orderdate) // 1000000) AS valid_from FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY directory) AS share FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY n DESC, author) AS r FROM s WHERE share >= 0.03)
SELECT directory, author, n, valid_from, round(share, 6) AS share, round(least(1.0, 0.5 + share / 2), 6) AS confidence FROM r WHERE r <= 3""")
def owners_share(t):
    changes = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_custkey", seconds("o_orderdate").alias("at"))
    found = discovery.owners(changes, directory="c_nationkey", author="o_custkey", at="at", least=0.03)
    return found.select("directory", "author", "n", "valid_from", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, parts[1] AS prefix FROM p WHERE len(parts) >= 1 UNION ALL SELECT page_id, parts[1] || '/' || parts[2] FROM p WHERE len(parts) >= 2""")
def rolls_up_prefix(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return discovery.under_prefixes(t.pages.select("page_id", path.alias("path")), ident="page_id", path="path")


@query("WITH p AS (SELECT least(x.l_suppkey, y.l_suppkey) AS src_id, greatest(x.l_suppkey, y.l_suppkey) AS dst_id, max(x.l_discount) AS weight FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey GROUP BY 1, 2) SELECT * FROM p")
def edge_canonical(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_discount", "l_linenumber")
    other = lines.select("l_orderkey", F.col("l_suppkey").alias("other"))
    rows = lines.join(other, "l_orderkey").select(F.col("l_suppkey").alias("src_id"), F.col("other").alias("dst_id"), F.lit("CO_CHANGED").alias("kind"), F.col("l_discount").alias("weight"), F.lit(1.0).alias("confidence"), F.lit("live").alias("status"), F.col("l_linenumber").alias("seq"))
    return merge.upserted_edges(rows).select("src_id", "dst_id", "weight")


@query(f"WITH {EDGES} SELECT src, dst, kind, round(w, 9) AS w FROM adj")
def adjacency_normalised(t):
    return graph.adjacency(edges(t)).select("src", "dst", "kind", F.round("w", 9).alias("w"))


@query(f"WITH {EDGES} SELECT kind, count(*) AS n, round(sum(weight), 6) AS weight FROM e GROUP BY kind")
def edge_density(t):
    return edges(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


REACH = "WITH RECURSIVE " + EDGES + """, reach(node, depth) AS (SELECT * FROM (VALUES ('S1', 0), ('S2', 0)) UNION SELECT dst, depth + 1 FROM reach JOIN adj ON src = node WHERE depth < 3)"""


def start(t) -> DataFrame:
    return t._spark.createDataFrame([("S1", 0.5), ("S2", 0.5)], "node string, p double")


@query(f"{REACH} SELECT node, min(depth) AS depth FROM reach GROUP BY node")
def reach_3hop(t):
    return graph.reachable(adjacent(t), start(t), 3)


@query(f"""WITH {EDGES}, one AS (SELECT src_id AS src, dst_id AS dst, weight FROM e UNION ALL SELECT dst_id, src_id, weight FROM e WHERE NOT directed),
a AS (SELECT dst AS node, max(weight) AS weight FROM one WHERE src = 'S1' AND dst <> 'S1' GROUP BY 1),
b AS (SELECT dst AS node, max(a.weight * one.weight) AS weight FROM a JOIN one ON src = a.node WHERE dst <> 'S1' AND dst NOT IN (SELECT node FROM a) GROUP BY 1)
SELECT node, depth, round(weight, 6) AS weight FROM (SELECT node, 1 AS depth, weight FROM a UNION ALL SELECT node, 2, weight FROM b) ORDER BY depth, weight DESC, node LIMIT 200""")
def graph_neighbors(t):
    return graph.neighbors(cut(edges(t)), "S1", 2).select("node", "depth", F.round("weight", 6).alias("weight"))


_STEPS = "".join(f""", p{k} AS MATERIALIZED (SELECT node, {k} AS depth, m.k AS via, m.s AS parent FROM (SELECT dst AS node, min({{'s': src, 'k': kind}}) AS m FROM adj JOIN p{k - 1} ON src = node GROUP BY dst)
WHERE node NOT IN ({" UNION ALL ".join(f"SELECT node FROM p{x}" for x in range(k))}))""" for k in (1, 2, 3))
PROVENANCE = f"WITH {EDGES}, p0 AS (SELECT * FROM (VALUES ('S1', 0, NULL::VARCHAR, NULL::VARCHAR), ('S2', 0, NULL, NULL)) v(node, depth, via, parent)){_STEPS}, every AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(4))})"


@query(f"{PROVENANCE} SELECT node, depth, parent, CASE WHEN depth = 0 THEN 'seed' ELSE depth || '-hop via ' || via END AS trail FROM every")
def provenance_depth(t):
    found = graph.provenance(adjacent(t), start(t), 3)
    return found.select("node", "depth", "parent", graph.trail(F.col("depth"), F.col("via")).alias("trail"))


def _rounds(prefix: str, n: int = 20) -> str:
    """Unrolled iterations over <prefix>u (universe), <prefix>adj."""
    p = prefix
    out = f""", {p}inside AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM {p}adj WHERE src IN (SELECT node FROM {p}u) AND dst IN (SELECT node FROM {p}u) GROUP BY 1, 2),
{p}sinks AS MATERIALIZED (SELECT node FROM {p}u WHERE node NOT IN (SELECT src FROM {p}adj)),
{p}base AS MATERIALIZED (SELECT node, CASE WHEN node IN ('S1', 'S2') THEN 0.5 ELSE 0.0 END::DOUBLE AS p FROM {p}u), {p}r0 AS MATERIALIZED (SELECT node, p AS rank FROM {p}base)"""
    for k in range(1, n + 1):
        r = f"{p}r{k - 1}"
        out += f""", {p}r{k} AS MATERIALIZED (SELECT b.node, 0.15 * b.p + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM {r} WHERE node IN (SELECT node FROM {p}sinks)) * b.p) AS rank
FROM {p}base b LEFT JOIN (SELECT i.dst AS node, sum(r.rank * i.w) AS flow FROM {r} r JOIN {p}inside i ON i.src = r.node GROUP BY 1) f ON f.node = b.node)"""
    return out


FIRST = REACH + ", u AS MATERIALIZED (SELECT DISTINCT node FROM reach)" + _rounds("")


@query(f"{FIRST} SELECT node, round(rank, 6) AS rank FROM r20")
def ppr_rank(t):
    return graph.pagerank(adjacent(t), start(t), tolerance=None).select("node", F.round("rank", 6).alias("rank"))


#: Nations that the seeds do not reach within three hops exist only on small scales; regions are modules, nations children.
DRILL = FIRST + """, hot AS MATERIALIZED (SELECT node FROM r20 WHERE node LIKE 'R%' AND rank > 0 ORDER BY rank DESC, node DESC LIMIT 3),
added AS MATERIALIZED (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation WHERE 'R' || n_regionkey IN (SELECT node FROM hot)),
more AS MATERIALIZED (SELECT src, dst, w FROM adj UNION ALL SELECT src, dst, 0.6 FROM added),
zadj AS MATERIALIZED (SELECT src, dst, CASE WHEN src IN (SELECT node FROM hot) THEN w / sum(w) OVER (PARTITION BY src) ELSE w END AS w FROM more),
zu AS MATERIALIZED (SELECT node FROM u UNION SELECT dst FROM added UNION SELECT dst FROM (SELECT z1.dst FROM zadj z0 JOIN zadj z1 ON z1.src = z0.dst WHERE z0.src IN ('S1', 'S2') UNION SELECT z2.dst FROM zadj z0 JOIN zadj z1 ON z1.src = z0.dst JOIN zadj z2 ON z2.src = z1.dst WHERE z0.src IN ('S1', 'S2')))""" + _rounds("z")


@query(f"{DRILL} SELECT node, round(rank, 6) AS rank FROM zr20")
def ppr_drilldown(t):
    adj = adjacent(t)
    rank = cut(graph.pagerank(adj, start(t), tolerance=None))
    modules = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    children = t.nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"))
    return graph.drilled(adj, rank, modules, children, start(t), tolerance=None).select("node", F.round("rank", 6).alias("rank"))
